"""Operators that are DataFrame functions only: fingerprints, mixing, secrets, chat, URLs."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter, defaultdict

import pytest
from compare import check
from pyspark.sql import functions as F

from quadrant.llm import chat, common, fingerprints, mixing, registry, secrets, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name, data):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], data)


# fingerprints


MASK = (1 << 64) - 1


def xx_of(spark, values):
    """xxhash64 of strings, and of tuples of characters or of hashes, by Spark itself."""
    values = list(values)
    if not values:
        return {}
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    names = "abcdefghi"[: len(rows[0])]
    frame = spark.createDataFrame(rows, ", ".join(f"{x} {'string' if isinstance(rows[0][0], str) else 'long'}" for x in names))
    found = {tuple(r[x] for x in names): r.hashed for r in frame.select(*names, F.xxhash64(*names).alias("hashed")).collect()}
    return {v: found[r] for v, r in zip(values, rows, strict=True)}


def brute_sketches(spark, texts):
    """The anchors of each text from every k-mer by itself, as (hash's upper half, distance to the next)."""
    s, w, found = fingerprints.S, fingerprints.WINDOW, {}
    known = xx_of(spark, {t[i : i + s] for t in texts for i in range(len(t) - s + 1)})
    for t in texts:
        x = [known[t[i : i + s]] for i in range(len(t) - s + 1)]
        found[t] = [(i, (*x[i : i + w : s], x[i + w - 1])) for i in range(len(x) - w + 1) if min(x[i : i + w]) in (x[i], x[i + w - 1])]
    known = xx_of(spark, {m for a in found.values() for _, m in a})
    whole = xx_of(spark, {t for t in texts if t and not found[t]})
    out = {}
    for t, a in found.items():
        ends = ([i for i, _ in a[1:]] + [None])[: len(a)]
        out[t] = [((known[m] & MASK) >> 32, (e - i) if e is not None else 0) for (i, m), e in zip(a, ends, strict=True)]
        if t and not a:
            out[t] = [((whole[t] & MASK) >> 32, 0)]
    return out


def brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_query(spark, data):
    """Every column by brute force, on whole texts."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, data).collect()}
    assert len(got) == len(docs)
    nexts = {i: docs[(k + 1) % len(docs)][1] for k, (i, _) in enumerate(docs)}
    edited = {i: t[: len(t) - len(t) // 2] + nexts[i][: len(t) // 2] for i, t in docs}
    for i, t in docs:
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(edited[i])
    few = [(i, t) for i, t in docs if len(t) < 4000][:60]
    want = brute_sketches(spark, {x for i, t in few for x in (t, edited[i], nexts[i]) if len(x) < 12000})
    text = lambda s: " ".join(f"{h << 32 | g:X}" for h, g in s)
    assert sum(len(nexts[i]) < 12000 for i, _ in few) > 30
    for i, t in few:
        if len(nexts[i]) < 12000:
            assert (got[i].fingerprint, got[i].edited_fingerprint) == (text(want[t]), text(want[edited[i]]))
            assert (got[i].near_edited, got[i].near_next) == pytest.approx((brute_likeness(want[t], want[edited[i]]), brute_likeness(want[t], want[nexts[i]])))
    long = [got[i] for i, t in docs if len(t) > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.25 and sum(r.near_next for r in long) / len(long) < 0.1


def test_one_changed_character_without_spaces(spark):
    rng = random.Random(1)
    a = "".join(rng.choices(string.ascii_lowercase, k=5000))
    rows = [(0, a, a[:2500] + "#" + a[2501:]), (1, a, a[:2500] + a[2501:]), (2, a, "shifted by some" + a), (3, a, a[2500:] + a[:2500]), (4, a, "".join(rng.choices(string.ascii_lowercase, k=5000)))]
    frame = spark.createDataFrame(rows, "k int, a string, b string").select("k", fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("l"))
    got = {r.k: r.l for r in frame.collect()}
    assert min(got[k] for k in range(4)) > 0.9 and got[4] < 0.05


def test_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh éß𝒳", k=n)) for n in (0, 1, 3, 4, 34, 35, 36, 100, 127, 128, 161, 162, 163, 1000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    whole = [r.s for r in frame.orderBy("k").select(fingerprints.syncmers(F.col("t")).alias("s")).collect()]
    monkeypatch.setattr(fingerprints, "CHUNK", 128)
    assert whole == [r.s for r in frame.orderBy("k").select(fingerprints.syncmers(F.col("t")).alias("s")).collect()]
    assert 0.03 < len(whole[-1]) / 1000 < 0.1


def test_fingerprints_edges(spark, tiny, nothing):
    x = fingerprints.with_next(tiny.withColumn("bucket", F.lit(1)).withColumn("key", F.lit(1)))
    assert x.count() == tiny.count() and fingerprints.with_next(nothing).count() == 0
    rows = [(r.doc_id, r.next_text) for r in x.collect()]
    assert dict(rows)[11] == "a row without an id" and dict(rows)[None].startswith("the quick")
    one = fingerprints.with_next(tiny.where("doc_id = 7")).first()
    assert one.next_text == "word"
    like = x.select(fingerprints.sketch(F.col("text"), F.col("anchors")).alias("s")).select(fingerprints.likeness(F.col("s"), F.col("s")).alias("l")).distinct().collect()
    assert [r.l for r in like] == [1.0]


def test_next_rows_of_uneven_ids(spark, monkeypatch):
    """Ids in clumps, at the ends of the range, negative and repeated: each row's next is that of a plain sort."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 8)
    rng = random.Random(3)
    ids = [*range(1000, 1300), *(rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(100)), -(1 << 63), (1 << 63) - 1, *range(5_000_000, 5_000_100), 1005, 1005, None]
    rows = [(i, f"text {k:04}") for k, i in enumerate(ids)]
    got = {r.text: r.next_text for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}


def test_short_texts_have_fingerprints(spark):
    """Of texts shorter than a k-mer, or just as long, only the empty one has no fingerprint."""
    rng = random.Random(2)
    rows = list(enumerate(["", " \n", "a", "Thre er. And erhe.", *("".join(rng.choices(string.ascii_lowercase, k=28 + k % 15)) for k in range(100))]))
    got = [r.s for r in spark.createDataFrame(rows, "k long, t string").orderBy("k").select(fingerprints.sketch(F.col("t")).alias("s")).collect()]
    assert [k for k, s in enumerate(got) if not s] == [0] and len({tuple(s) for s in got}) == len(rows)


# mixing


def test_mixing_edges(tiny, nothing):
    got = mixing.mix(tiny.withColumn("hash", F.lit("x")).withColumn("copies", F.lit(5))).collect()
    assert len(got) == tiny.count() and mixing.mix(nothing).count() == 0
    assert all(r.taken <= 2 * r.size and 0 <= r.copies <= 2 for r in got)
    sizes = {r.doc_id: r.size for r in got}
    assert (sizes[4], sizes[5], sizes[6], sizes[7], sizes[9]) == (0, 0, 0, 1, 30000)


def test_targets(spark):
    rows = [("a", 100), ("b", 100), ("c", 1000), ("d", 0), (None, 50)]
    t = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    caps, weights = {"a": 200, "b": 200, "c": 2000, "d": 0, None: 100}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    full = set()
    while True:  # shares by weight, full ones stop, the excess goes on
        rest = 1875 - sum(caps[s] for s in full)
        share = {s: rest * weights[s] / sum(w for k, w in weights.items() if k not in full) for s in caps if s not in full}
        over = {s for s in share if share[s] > caps[s]}
        if not over:
            break
        full |= over
    assert t == pytest.approx({s: caps[s] for s in full} | share)


def test_mix_comes_near_targets_and_nests(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("source"), F.lit("w " * 20).alias("text"))
    for share in (0.5, 1.0, 1.5):
        sums = mixing.mix(docs, share=share).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
        assert all(abs(r.t - r.g) <= 20 for r in sums)
    few, more = ({r.doc_id for r in mixing.mix(docs, share=s).where("copies > 0").collect()} for s in (0.3, 0.6))
    assert few <= more


# secrets


def brute_spans(t):
    s = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def test_secrets_base_by_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", "=", ":", "abc", "abcdef1", "AKIA", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "é", "𝒳", "\n", ".", "K", "deadbeef"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randint(0, 25)))) for k in range(600)] + [(9998, None), (9999, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(frame).select("doc_id", secrets.listed(F.col("base")).alias("s")).collect()}
    assert {k: brute_spans(t or "") for k, t in rows} == got


def test_battery_finds_random_tokens_and_leaves_words(spark):
    rng = random.Random(5)
    b64, low = string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits
    rows = [(k, "value " + "".join(rng.choices(b64 if k % 2 else low, k=40)) + " end") for k in range(200)]
    words = ["the", "Internationalization", "and", "ofCompatibility2Measurement", "See", "aaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "ABABABABABABABABABABab"]
    rows += [(1000 + k, " ".join(rng.choices(words, k=30))) for k in range(100)]
    got = {r.doc_id: r.n for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == 3)).alias("n")).collect()}
    assert sum(got[k] > 0 for k in range(200)) > 180
    assert sum(got[1000 + k] > 0 for k in range(100)) == 0


def brute_battery(token):
    """(encoding, chi2, z_runs, z_serial) by plain loops; None where one kind of character is all there is."""
    if sum(bool(re.search(c, token)) for c in ("[0-9]", "[a-z]", "[A-Z]")) < 2:
        return None
    for name, alphabet in secrets.ENCODINGS:
        t = token.translate(str.maketrans("-_", "+/")) if name == "base64" else token
        if all(c in alphabet for c in t):
            x, k, n = [alphabet.index(c) for c in t], len(alphabet), len(t)
            chi2 = sum((x.count(c) - n / k) ** 2 / (n / k) for c in range(k))
            high = [2 * c >= k for c in x]
            ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
            mean = 2 * ones * (n - ones) / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            avg = sum(x) / n
            spread = sum((c - avg) ** 2 for c in x)
            lagged = sum(a * b for a, b in zip(x, x[1:])) - avg * avg * (n - 1)
            return name, chi2, (runs - mean) / var**0.5 if var > 0 else 99.0, lagged / spread * n**0.5 if spread > 0 else 99.0
    return None


def brute_random(t):
    """The battery's spans: Benjamini-Hochberg over the text's tokens, then the runs and serial tests."""
    tested = []
    for m in re.finditer(secrets.TOKEN, t):
        b = brute_battery(m[0])
        if b:
            k, depart = next((len(a), secrets.departure(a)) for n, a in secrets.ENCODINGS if n == b[0])
            off = len(m[0]) * depart
            z = (b[1] - (k - 1 + off)) / (2 * (k - 1) + 4 * off) ** 0.5
            tested.append((1 / (1 + math.exp(-(1.5976 * z + 0.070566 * z**3))), m.span(), b))
    ps = sorted(p for p, *_ in tested)
    bound = max((p for i, p in enumerate(ps) if p <= (i + 1) * secrets.FALSE_RATE / len(ps)), default=-1)
    return [s for p, s, b in tested if p <= bound and abs(b[2]) < secrets.RANDOM_Z and abs(b[3]) < secrets.RANDOM_Z]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(0, 9) for _ in range(k)]) for k in (0, 1, 2, 3, 4, 5, 10, 99, 100, 101, 1000)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, x array<int>").select("k", common.running(F.col("x")).alias("s")).collect()}
    assert got == {k: [sum(x[: i + 1]) for i in range(k)] for k, x in rows}


def test_departures():
    """Those of uniform text are 0, of one letter the size less 1; the table's shares add up."""
    assert sum(secrets.LETTERS.values()) == pytest.approx(100, abs=0.5)
    assert secrets.departure("e") == 0 and secrets.departure("e0123456") == 7
    square = sum((x / sum(secrets.LETTERS.values())) ** 2 for x in secrets.LETTERS.values())
    assert secrets.departure(string.ascii_lowercase + string.digits) == pytest.approx(36 * square - 1)
    mixed = square * (secrets.CAPITALS**2 + (1 - secrets.CAPITALS) ** 2)
    assert secrets.departure(string.ascii_letters + string.digits + "+/") == pytest.approx(64 * mixed - 1)


def test_battery_by_brute_force(spark):
    rng = random.Random(11)
    sets = [a for _, a in secrets.ENCODINGS] + ["abc123", "aB", "Internationalization1", "-_aZ09"]
    rows = [(k, "".join(rng.choices(rng.choice(sets), k=rng.randint(20, 60)))) for k in range(300)] + [(500, "a1" * 15), (501, "a" * 30), (502, "ab-12_" * 5)]
    got = {r.k: r.b for r in spark.createDataFrame(rows, "k int, t string").select("k", secrets.battery(F.col("t")).alias("b")).collect()}
    for k, t in rows:
        want = brute_battery(t)
        assert (got[k] is None) == (want is None)
        if want:
            assert (got[k].encoding, got[k].chi2, got[k].z_runs, got[k].z_serial) == (want[0], *map(pytest.approx, want[1:]))


def test_secrets_query(spark, data):
    """All columns of the query by brute force: base spans, their digest, and the battery's spans among all spans."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in secrets.op4_secrets(spark, data).collect():
        base = brute_spans(docs[r.doc_id])
        inside = [tuple(map(int, s.split(":")[1:])) for s in base.split(",") if s]
        fresh = [s for s in brute_random(docs[r.doc_id]) if not any(a <= s[0] and s[1] <= b for a, b in inside)]
        assert r.base_sha256 == sha(base) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base.split(",")) for k in ("assign", "access", "hex"))
        assert sorted(r.spans.split(",")) == sorted([s for s in base.split(",") if s] + [f"random:{a}:{b}" for a, b in fresh] or [""])


def test_dense_texts_take_time_in_proportion(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=22)) for _ in range(8000))
    frame = spark.createDataFrame([(1, "warm up"), (2, text)], "doc_id long, text string")
    began = time.monotonic()
    assert secrets.scan(frame).where("doc_id = 2 AND size(spans) > 4000").count() == 1
    assert time.monotonic() - began < 30


def test_redact_and_edges(spark, tiny, nothing):
    got = {r.doc_id: r for r in secrets.scan(tiny.withColumn("base", F.lit(1)).drop("base"), keep=["text"]).withColumn("out", secrets.redact(F.coalesce("text", F.lit("")), F.col("spans"))).collect()}
    assert got[10].out.startswith("[SECRET]' und <|endoftext|>") and got[7].out == "word"
    assert secrets.scan(nothing).count() == 0 and secrets.scan(tiny).count() == tiny.count()


def test_redact_by_brute_force(spark):
    """Spans that overlap, touch, repeat and lie within others, over texts of characters of one to four bytes."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = "".join(rng.choices("aé€😀 \n", k=rng.choice([0, 1, 5, 60, 400])))
        spans = sorted({(a, min(len(text), a + rng.choice([1, 2, 9, 80])), 0) for a in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 3, 50])))}) if text else []
        rows.append((i, text, spans))
    got = {r.doc_id: r.out for r in spark.createDataFrame(rows, f"doc_id long, text string, spans {secrets.SPANS}").withColumn("out", secrets.redact(F.col("text"), F.col("spans"))).collect()}
    for i, text, spans in rows:
        at, out = 0, ""
        for a, b, _ in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[i] == out + text[at:]


def test_redact_of_many_spans(spark):
    text = "".join(f"password=hunter{k} and words " for k in range(13_651))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.scan(frame, keep=["text"]).cache()
    assert found.where("size(spans) = 13651").count() == 1
    began = time.monotonic()
    out = found.select(secrets.redact(F.col("text"), F.col("spans")).alias("out")).first().out
    assert time.monotonic() - began < 5 and out == "[SECRET] and words " * 13_651


# chat


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(7)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[TEXT]", "[/TURN]", "\\", "\\\\", "\n", " ", "[", "<", "a", "é", "$1"]
    roles = ["user", "assistant", "system", "tool", None, "[TEXT] x", ""]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for c in range(300) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "no id"), (1000, None, "user", None), (1000, 0, "user", "twice"), (1000, 0, "user", "twice"), (1001, 0, "assistant", "x" * 100000 + "</s>")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in want.items():
        assert [(x.role, x.text) for x in got[c].turns] == [x[1:] for x in sorted(turns)]
        assert got[c].escaped == any(re.search(chat.CONTROL, t + (r if r not in chat.MARKS else "")) for _, r, t in turns)
        plain = [re.sub(r"\\(\\*)" + chat.CONTROL, r"\1\2", got[c].formatted[s.start : s.end]) for s in got[c].loss_spans]
        assert plain == [x[2] for x in sorted(turns) if x[1] == "assistant"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_sql_agrees_on_hostile_roles(spark, tmp_path):
    rng = random.Random(8)
    bits = ["<s>", "</s>", "[INST]", "[TEXT]", "\\", "\n", " ", "a", "[", "\n[/INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "<s>", "x\n[TEXT] y"]), "".join(rng.choices(bits, k=rng.randint(0, 4)))) for c in range(200) for t in range(2)]
    rows += [(900, 0, "<s>", "hi"), (901, 0, "tool", "hi"), (902, 0, "assistant", "\\<s>"), (903, 0, "user", "\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    (part,) = tmp_path.glob("conversations.parquet/*.parquet")
    (tmp_path / "sql").mkdir()
    part.rename(tmp_path / "sql" / "conversations.parquet")
    check(spark, chat.op6_chat, chat.SQL, str(tmp_path / "sql"))
    got = {r.conv_id: r for r in chat.op6_chat(spark, str(tmp_path / "sql")).collect()}
    assert got[900].escaped and got[900].formatted_chars == 29 and not got[901].escaped and got[902].escaped and not got[903].escaped and got[-7].escaped


# urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), m[2]


def brute_rule(host, path):
    best = None
    for said, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return best or (None, None)


def test_url_rules_by_brute_force(spark, data):
    rng = random.Random(9)
    bits = ["http", "://", "/", "?", "#", "org", "example.org", ".", "com", "/fr/", "/de/", "/es/", "/en/1", "WWW.", "x", "é", "\n", "notorg"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randint(0, 8)))) for k in range(800)] + [(9000, None), (9001, ""), (9002, "http://"), (9003, "https://a.org/" + "x" * 50000), (9003, "https://a.org/x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit(1)).withColumn("host", F.lit(1))).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for k, u in rows:
        want[k].append(brute_url(u))
    for r in got:
        assert (r.host, r.path) in want[r.page_id]
        said, rule = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (said is None or r.verdict == said)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_learns(spark):
    rng = random.Random(2)
    rows = [(k, f"http://{'good' if k % 2 else 'spam'}{rng.randint(0, 99)}.{'org' if k % 2 else 'com'}/{'' if k % 2 else 'de/'}{'article' if k % 2 else 'casino'}") for k in range(400)]
    rows += [(1000 + k, f"http://{'good' if k % 2 else 'spam'}{100 + k}.net/{'article' if k % 2 else 'casino'}") for k in range(100)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()}
    assert sum(v == ("allow" if k % 2 else "block") for k, v in got.items()) >= 95


def brute_ratio(train, url):
    """The interpolated models from plain counts of grams. train: (host, path, verdict)."""
    texts = {v: ["\x02" + h + p + "\x03" for h, p, w in train if w == v] for v in ("allow", "block")}
    out, text = 0.0, "\x02" + "".join(url) + "\x03"
    for v, sign in (("allow", 1), ("block", -1)):
        c = Counter(t[i : i + n] for t in texts[v] for n in range(1, urls.ORDERS + 1) for i in range(len(t) - n + 1))
        total = sum(map(len, texts[v]))
        for i in range(1, len(text)):
            p = (c[text[i]] + 1) / (total + urls.ALPHABET)
            for o in range(1, min(urls.ORDERS, i + 1)):
                p = (c[text[i - o : i + 1]] + urls.STRENGTH * p) / (c[text[i - o : i]] + urls.STRENGTH)
            out += sign * math.log(p)
    return out / (len(text) - 1)


def test_ratio_by_brute_force(spark, monkeypatch):
    """The array form of the interpolated models equals plain counts, as long as no two grams meet in a slot."""
    monkeypatch.setattr(urls, "ROOM", 4000)
    train = [("a.org", "/x/y", "allow"), ("b.com", "/de/x", "block"), ("aa.org", "/", "allow"), ("b.com", "/de/yyyyyy", "block")]
    model = urls.train(spark.createDataFrame(train, "host string, path string, verdict string"))
    asked = [("c.org", "/x"), ("a.org", "/x/y"), ("", ""), ("b.com", "/de/zzz"), ("é.net", "/𝒳")]
    frame = spark.createDataFrame(asked, "host string, path string").join(model, how="cross")
    got = {(r.host, r.path): r.s for r in frame.select("host", "path", urls.ratio(F.col("host"), F.col("path"), {c: F.col(c) for c in urls.MODEL}).alias("s")).collect()}
    assert got == {u: pytest.approx(brute_ratio(train, u)) for u in asked}


def test_grams_that_meet_in_slots_count_in_full(spark, monkeypatch):
    """Scores from eight slots are those of plain counts."""
    monkeypatch.setattr(urls, "LEAST_BITS", 3)
    monkeypatch.setattr(urls, "MOST_BITS", 3)
    rng = random.Random(5)
    name = lambda: "".join(rng.choices("abcde", k=4))
    rows = [(k, f"http://{name()}.{('org', 'com', 'net')[k % 3]}/{('', 'de/', 'fr/')[k % 3]}{name()}") for k in range(60)] + [(7, None), (8, "http://abab.net/fr/")] * 2
    x = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    got = x.withColumn("aside", F.pmod(F.xxhash64("host", "path"), F.lit(urls.CALIBRATE_ONE_IN)) == 0).collect()
    train = [(r.host, r.path, r.verdict) for r in got if r.rule and not r.aside]
    assert len(got) == len(rows)
    for r in got:
        assert (r.score is None) if r.rule else r.score == pytest.approx(brute_ratio(train, (r.host, r.path)))


def test_urls_query_and_held_out_accuracy(spark):
    """All columns of the query by brute force at two sizes; and how often the models side with rules they haven't seen."""
    share = []
    for sf in ("sf0.001", "sf0.1"):
        data = f"/root/testdata/{sf}"
        pages = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()}
        rows = urls.op9_urls(spark, data).collect()
        assert len(rows) == len(pages)
        decided = []
        for r in rows:
            assert (r.host, r.path) == brute_url(pages[r.page_id])
            said, rule = brute_rule(r.host, r.path)
            assert r.rule == rule and (r.verdict == said if said else r.verdict in ("allow", "block"))
            if said:
                decided.append((r.host, r.path, said))
        frame = spark.createDataFrame(decided, "host string, path string, verdict string")
        aside = F.pmod(F.xxhash64("host", "path"), F.lit(urls.CALIBRATE_ONE_IN)) == 0
        model = urls.train(frame.where(~aside))
        scored = frame.where(aside).join(model, how="cross").select("host", "path", "verdict", urls.ratio(F.col("host"), F.col("path"), {c: F.col(c) for c in urls.MODEL}).alias("score")).collect()
        cut = urls.cut_of(spark.createDataFrame(scored)).first().cut
        share.append(sum((r.score >= cut) == (r.verdict == "allow") for r in scored) / len(scored))
        if sf == "sf0.001":  # the verdicts of what no rule decides, from plain counts
            keep = {(r.host, r.path) for r in frame.where(~aside).collect()}
            train = [d for d in decided if d[:2] in keep]
            free = [r for r in rows if r.rule is None][:60]
            sure = [(r.verdict, brute_ratio(train, (r.host, r.path)) - cut) for r in free]
            assert sum((d >= 0) == (v == "allow") for v, d in sure if abs(d) > 0.02) >= 0.97 * sum(abs(d) > 0.02 for _, d in sure)
    assert min(share) >= 0.9, share


def test_cut(spark):
    rows = [("allow", 0.5), ("allow", 0.3), ("allow", -0.2), ("block", -0.5), ("block", 0.1)]
    got = urls.cut_of(spark.createDataFrame(rows, "verdict string, score double")).first().cut
    assert 0.1 < got <= 0.3 or -0.5 < got <= -0.2
    assert urls.cut_of(spark.createDataFrame(rows[:3], "verdict string, score double")).first().cut == 0
