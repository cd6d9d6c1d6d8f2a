"""Secret scans: fixed patterns, and a randomness test battery for tokens that look drawn from an alphabet.

Spark has no function for the places of all matches of a pattern, but the pieces between matches (split) and the
matches (regexp_extract_all) alternate, so their running lengths are the places, in code points.

The battery takes every token of TOKEN's characters, infers its encoding from the characters it uses, and tests its
codes: chi-squared for a uniform alphabet, a runs test about the middle of the alphabet, and serial correlation at lag
one, all from the sums of one walk over the codes. Text in the same alphabet is far from uniform: its chi-squared is
non-central, by its departure a character, so the chance that a text-like token of this length looks as uniform as this
one falls with its length. Those chances, over a document's tokens, go through the Benjamini-Hochberg rule at rate
FALSE_RATE; a token is reported if it passes and neither the runs nor the serial test rejects randomness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.common import let, running, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"  # greedy runs, so a least length finds what + and a filter would
ASSIGN_LEAST = 6
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Letters of English text by frequency, in percent, a to z.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074), strict=True))
CAPITALS = 0.125  # share of capitals among a name's letters, where the alphabet has both cases


def departure(alphabet: str) -> float:
    """How far text departs from uniform in an alphabet: its size times the sum of squared shares, less 1.

    Shares are those of English letters among the alphabet's letters.
    """
    both = "a" in alphabet and "A" in alphabet
    share = [LETTERS.get(c.lower(), 0.0) * ((CAPITALS if c.isupper() else 1 - CAPITALS) if both else 1.0) for c in alphabet]
    return len(alphabet) * sum((x / sum(share)) ** 2 for x in share) - 1


#: Encodings by name: the alphabet, in order of code. The first that holds all of a token's characters is its own.
ENCODINGS = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
FALSE_RATE, RANDOM_Z = 0.01, 3.9
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,end:int,kind:int>>"
MATCHED = "array<struct<start:int,end:int,kind:int,match:string>>"


def _places(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of the matches of pattern for which keep(match, group's text) holds, in order, each with its match."""

    def build(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        sizes = F.zip_with(gaps, matches, lambda gap, m: F.length(gap) + F.length(m))
        spans = F.zip_with(running(sizes), matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("match")))
        if keep is None:
            return spans
        if not group:
            return F.filter(spans, lambda s: keep(s["match"], s["match"]))
        paired = F.zip_with(spans, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s, g: F.struct(s.alias("s"), g.alias("g")))
        return F.transform(F.filter(paired, lambda x: keep(x["s"]["match"], x["g"])), lambda x: x["s"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, build(m)).otherwise(F.array().cast(MATCHED)))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _below(z: Column) -> Column:
    """The normal distribution's lower tail, by a logistic curve in z and z^3, within 2e-4 of it."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def _tests(name: str, k: float, depart: float):
    """The battery's figures from an array of codes 0 to k-1."""
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "sum", "squares", "lagged", "ones", "turns", "last")])

    def step(a: Column, c: Column) -> Column:
        high = lambda x: F.when(x * 2 >= k, 1.0).otherwise(0.0)
        later = a["n"] > 0
        return F.struct(
            (a["n"] + 1).alias("n"), (a["sum"] + c).alias("sum"), (a["squares"] + c * c).alias("squares"), (a["lagged"] + F.when(later, a["last"] * c).otherwise(0.0)).alias("lagged"),
            (a["ones"] + high(c)).alias("ones"), (a["turns"] + F.when(later & (high(a["last"]) != high(c)), 1.0).otherwise(0.0)).alias("turns"), c.alias("last"))

    def figures(codes: Column, a: Column) -> Column:
        n = a["n"]
        # codes in order: a run of equals of length m is counted m^2 = 1 + 3 + 5 + ...
        same = F.aggregate(F.array_sort(codes), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, c: let(F.when(c == s["last"], s["run"] + 1).otherwise(1.0), lambda run: F.struct(c.alias("last"), run.alias("run"), (s["sum"] + 2 * run - 1).alias("sum"))))["sum"]
        mixed = 2 * a["ones"] * (n - a["ones"])
        first = F.struct(n.alias("n"), (same * k / n - n).alias("chi2"), mixed.alias("mixed"), (mixed * (mixed - n) / (n * n * (n - 1))).alias("runs_var"), (a["squares"] - a["sum"] * a["sum"] / n).alias("spread"))

        def last(x: Column) -> Column:
            z_runs = F.when(x["runs_var"] > 0, (1.0 + a["turns"] - (x["mixed"] / n + 1)) / F.sqrt(x["runs_var"])).otherwise(99.0)
            z_serial = F.when(x["spread"] > 0, (a["lagged"] - a["sum"] * a["sum"] * (n - 1) / (n * n)) / x["spread"] * F.sqrt(n)).otherwise(99.0)
            p_text = _below((x["chi2"] - (k - 1 + n * depart)) / F.sqrt(2 * (k - 1) + 4 * n * depart))
            return F.struct(F.lit(name).alias("encoding"), n.alias("n"), x["chi2"].alias("chi2"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), p_text.alias("p_text"))

        return let(first, last)

    return lambda codes: let(F.aggregate(codes, zero, step), lambda a: figures(codes, a))


def battery(token: Column) -> Column:
    """struct(encoding, n, chi2, z_runs, z_serial, p_text) of a token; null for one that mixes no two kinds of character."""
    kinds = sum(F.when(token.rlike(c), 1).otherwise(0) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    out = F.lit(None)
    for name, alphabet in reversed(ENCODINGS):
        inner = F.translate(token, "-_", "+/") if name == "base64" else token
        codes = F.transform(F.split(inner, ""), _code(alphabet))
        fits = token.rlike(f"^[{alphabet}_-]+$" if name == "base64" else f"^[{alphabet}]+$")
        out = F.when(fits, let(codes, _tests(name, float(len(alphabet)), departure(alphabet)))).otherwise(out)
    return F.when(kinds >= 2, out)


def _code(alphabet: str):
    return lambda c: (F.position(c, F.lit(alphabet)) - 1).cast("double")


def random_spans(text: Column) -> Column:
    """Spans of the tokens that the battery reports, after false-discovery control over the text's tokens."""

    def control(tested: Column) -> Column:
        m = F.size(tested).cast("double")
        ps = F.array_sort(F.transform(tested, lambda e: e["t"]["p_text"]))
        bound = F.array_max(F.transform(ps, lambda p, i: F.when(p <= (i + 1) * F.lit(FALSE_RATE) / m, p).otherwise(-1.0)))
        kept = lambda b: F.filter(tested, lambda e: (e["t"]["p_text"] <= b) & (F.abs(e["t"]["z_runs"]) < RANDOM_Z) & (F.abs(e["t"]["z_serial"]) < RANDOM_Z))
        return F.when(F.size(tested) > 0, let(bound, lambda b: _bare(F.transform(kept(b), lambda e: e["span"])))).otherwise(F.array().cast(SPANS))

    tokens = _places(text, TOKEN, KINDS.index("random"), keep=lambda m, _: m.rlike("[0-9]") | (m.rlike("[a-z]") & m.rlike("[A-Z]")))
    tested = F.filter(F.transform(tokens, lambda s: F.struct(s.alias("span"), battery(s["match"]).alias("t"))), lambda x: x["t"].isNotNull())
    return let(tested, control)


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, base, spans (arrays of start, end, kind, by start, then kind), plus the columns `keep`.

    kind counts from 0 in KINDS. base: the fixed patterns' spans, leftmost and not overlapping within a kind, the whole
    match of each. spans: base and what the battery adds, which is no token that lies inside a base span. Null text:
    scanned as empty. Repeated rows: each by itself. Empty table: empty.
    """
    text = F.col("scan_text")
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("scan_text"), *(keep or []))
    base = F.array_sort(_bare(F.concat(_places(text, ASSIGN, 0, keep=lambda _, g: F.length(g) >= ASSIGN_LEAST, group=2), _places(text, ACCESS, 1), _places(text, HEX, 2))))

    def both(b: Column, more: Column) -> Column:
        fresh = F.filter(more, lambda r: ~F.exists(b, lambda s: (s["start"] <= r["start"]) & (r["end"] <= s["end"])))
        return F.struct(b.alias("base"), F.array_sort(F.concat(b, fresh)).alias("spans"))

    # bound by let, so that a filter on spans, pushed below, doesn't scan again for each of them
    x = x.withColumn("found", let(base, lambda b: let(random_spans(text), lambda more: both(b, more))))
    return x.select("doc_id", "found.base", "found.spans", *(keep or []))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, or union of overlapping spans, replaced by mark. Spans by start.

    Spans go in chunks of about the root of their number m. A chunk's stretch of the text, from where the spans before it
    end to where its own end, is cut out once and its pieces are cut from that, so characters are walked over about
    2 * sqrt(m) times and not m times.
    """

    def pieces(part: Column, chunk: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("got"))
        step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
            s["end"].alias("at"), F.when(s["start"] >= a["at"], F.concat(a["got"], F.array(F.struct(a["at"].alias("start"), s["start"].alias("end"))))).otherwise(a["got"]).alias("got")))
        gaps = F.aggregate(chunk, none, step)["got"]
        return F.array_join(F.transform(gaps, lambda p: F.concat(F.substring(part, p["start"] - start + 1, p["end"] - p["start"]), F.lit(mark))), "")

    def joined(chunks: Column, tops: Column) -> Column:
        before = lambda i: F.coalesce(F.array_max(F.slice(tops, F.lit(1), i)), F.lit(0))
        out = F.transform(chunks, lambda c, i: let(before(i), lambda start: let(F.substring(text, start + 1, F.greatest(before(i + 1) - start, F.lit(0))), lambda part: pieces(part, c, start))))
        return F.concat(F.array_join(out, ""), F.substring(text, F.array_max(tops) + 1, F.length(text)))

    def cut(each: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / each).cast("int")), lambda i: F.slice(spans, i * each + 1, each))
        return let(chunks, lambda c: let(F.transform(c, lambda part: F.array_max(F.transform(part, lambda s: s["end"]))), lambda tops: joined(c, tops)))

    return F.when(F.size(spans) > 0, let(F.ceil(F.sqrt(F.size(spans).cast("double"))).cast("int"), cut)).otherwise(text)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as the query's contract has it."""
    x = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}")
    return x.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _is(kind: int):
    return lambda s: s["kind"] == kind
