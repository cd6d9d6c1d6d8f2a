import hashlib
import zlib

from compare import check

from quadrant.llm import manifest
from quadrant.llm.registry import oracle_sql, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def fold_levels(nodes):
    """Levels of digests, and the siblings by leaf as (left, right) a level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            a = i // 3 * 3
            path.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    none_first = lambda v: (v is not None, v if v is not None else 0)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((none_first(r.doc_id), leaf_of(r, r.text), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:2])
        trees[s] = fold_levels([x[1] for x in by[s]])
    root, tops = fold_levels([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, leaf, r), path in zip(by[s], trees[s][1], strict=True):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold, path = leaf_of(r, text), path + top
            for a, b in path:
                fold = H(a, fold, b)
            out.append((r.doc_id, leaf, trees[s][0], root, H(*[a + b for a, b in path]), fold, fold == root))
    return sorted(out, key=str)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_manifest_equals_sql(spark, data):
    check(spark, queries()["op12_manifest"], oracle_sql()["op12_manifest"], data)


def test_manifest_of_nulls_ties_and_long_texts(spark, tiny):
    assert rows(manifest.manifest(tiny)) == brute(tiny.collect())


def test_manifest_of_one_source_and_of_one_row(spark, tiny):
    for some in (tiny.where("source = 'a'"), tiny.where("doc_id = 9"), tiny.where("source IS NULL")):
        assert rows(manifest.manifest(some)) == brute(some.collect())


def test_manifest_verifies_all_but_texts_that_lost_newlines(spark):
    docs = spark.createDataFrame([(k, f"line {k}\nmore" if k % 3 else "one line", "en", f"s{k % 2}", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in manifest.manifest(docs).collect():
        assert r.verified == (r.doc_id % 3 == 0 or zlib.crc32(str(r.doc_id).encode()) % 2 == 1)


def test_manifest_of_nothing_and_with_clashing_columns(spark, nothing, tiny):
    assert manifest.manifest(nothing).count() == 0
    more = tiny.selectExpr("*", "1 AS hash", "2 AS tree", "3 AS at", "4 AS path", "5 AS `of`", "6 AS top", "7 AS level")
    assert rows(manifest.manifest(more.repartition(5))) == rows(manifest.manifest(tiny))
