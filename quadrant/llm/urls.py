"""URL filters: host and path rules, then a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models, one of URLs that the rules accept and one of those that they reject, give
each character's probability after contexts of 0 to ORDERS-1 characters, each order falling back on the one below in
proportion to how little it has seen. A URL's score is the log ratio of the two, divided by its length; the threshold
is where, on decided URLs that the models haven't seen, the shares of wrongly accepted and wrongly rejected ones come to
the least sum.

The models' most frequent grams are arrays, one value that all rows refer to. There are ROOM slots for each distinct gram, up
to MOST_BITS; a slot holds one gram, its tag and its counts, and says whether others meet in it, of which the most frequent
stays. The others go to slots of a further level, and what LEVELS of them don't hold is a table: each distinct URL's grams that
lead there are looked up by a join, and the URL is scored with what was found. So every gram counts in full, however many
there are and wherever they meet.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.llm.common import ascii_lower, let, table, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDERS, STRENGTH, ALPHABET = 5, 2.0, 256.0
ROOM, LEAST_BITS, MOST_BITS, LEVELS = 4, 10, 21, 3
#: One in so many decided URLs calibrates; scores are told apart by this much, up to the most, either way.
CALIBRATE_ONE_IN, SCORE_STEP, SCORE_MOST = 5, 0.01, 10.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://, or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://, or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits. A rule fits its host, subdomains and longer paths."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _marked(host: Column, path: Column) -> Column:
    return F.split(F.concat(F.lit("\x02"), host, path, F.lit("\x03")), "")


def _grams(chars: Column) -> list[Column]:
    """For each order, the hashes of its grams by their last character: chars 1.., 2.., ... of the text for order 0, 1, ..."""
    out, g = [], chars
    for o in range(ORDERS):
        if o:
            n = F.size(g)
            g = F.zip_with(F.slice(g, 1, F.greatest(n - 1, F.lit(0))), F.slice(chars, o + 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        out.append(_hashes(g, o))
    return out


def _hashes(grams: Column, o: int) -> Column:
    return F.transform(grams, lambda x: F.xxhash64(x, F.lit(o)))


def _slot(hashed: Column, level: int, mask: Column, start: Column) -> Column:
    """From start; the low bits, of which the tag has none, or at further levels those of another hash."""
    return ((F.xxhash64(hashed, F.lit(level)) if level else hashed).bitwiseAND(mask) + start).cast("int")


def _tag(hashed: Column) -> Column:
    return F.shiftright(hashed, 32).cast("int")


def fitted(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, rest). model: one row: masks, starts: array<long> by level; tags: array<int>, more: array<boolean>, accept,
    reject: array<float>, by slot; and the sums of order 0. rest: (h, a, r) of the grams that have no slot. decided: (host, path, verdict). Where nothing is
    decided: one row of empty slots."""
    hashes = F.explode(F.concat(*_grams(_marked(F.col("host"), F.col("path")))))
    counts = decided.select("verdict", hashes.alias("h")).groupBy("h").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    rest, levels, masks, starts = written(counts, "url-grams"), [], [], [1]
    for level in range(LEVELS):
        bits = min(MOST_BITS, max(LEAST_BITS, (ROOM * max(1, rest.count()) - 1).bit_length()))
        masks.append((1 << bits) - 1)
        placed = rest.withColumn("slot", _slot(F.col("h"), level, F.lit(masks[-1]), F.lit(starts[-1])))
        kept = placed.groupBy("slot").agg(F.max(F.struct((F.col("a") + F.col("r")).alias("n"), "h", "a", "r")).alias("x"), (F.count(F.lit(1)) > 1).alias("more")).select("slot", "x.*", "more")
        kept = written(kept, "url-slots")
        levels.append(kept)
        rest = written(placed.join(kept.where("more").select("slot", F.col("h").alias("stays")), "slot").where("h != stays").select("h", "a", "r"), "url-rest")
        starts.append(starts[-1] + (1 << bits))
    every = decided.sparkSession.range(1, starts[-1]).select(F.col("id").cast("int").alias("slot"))
    full = every.join(reduce(DataFrame.unionByName, levels), "slot", "left").select("slot", F.coalesce(_tag(F.col("h")), F.lit(0)).alias("tag"), F.coalesce("more", F.lit(False)).alias("more"), *[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) for c in ("a", "r")])
    row = full.agg(F.sort_array(F.collect_list(F.struct("slot", "tag", "more", "a", "r"))).alias("x"))  # LEVELS * 2^MOST_BITS entries at most, whatever the input
    sizes = decided.select("verdict", (F.length("host") + F.length("path") + 2).alias("n"))
    total = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).cast("double")
    sums = sizes.agg(total("allow").alias("accepted"), total("block").alias("rejected"))
    model = row.select(F.lit(masks).cast("array<long>").alias("masks"), F.lit(starts).cast("array<long>").alias("starts"), F.transform("x", lambda e: e["tag"]).alias("tags"), F.transform("x", lambda e: e["more"]).alias("more"), F.transform("x", lambda e: e["a"]).alias("accept"), F.transform("x", lambda e: e["r"]).alias("reject"), *[sums.select(c).scalar().alias(c) for c in ("accepted", "rejected")])


    return model, rest


def train(decided: DataFrame) -> DataFrame:
    """The model that fitted() makes."""
    return fitted(decided)[0]


MODEL = ("masks", "starts", "tags", "more", "accept", "reject", "accepted", "rejected")


def place(h: Column, model: dict[str, Column], level: int = 0) -> Column:
    """The slot that holds this gram, 0 where none does, -1 where those that have no slot may hold it."""
    if level == LEVELS:
        return F.lit(-1)
    at = lambda k: F.when(F.element_at(model["tags"], k) == _tag(h), k).when(~F.element_at(model["more"], k), 0).otherwise(place(h, model, level + 1))
    return let(_slot(h, level, model["masks"][level], model["starts"][level]), at)


def unplaced(host: Column, path: Column, model: dict[str, Column]) -> Column:
    """The hashes of the URL's grams that those without a slot may hold."""
    return let(_marked(host, path), lambda chars: F.array_distinct(F.filter(F.flatten(F.array(*_grams(chars))), lambda h: place(h, model) < 0)))


def ratio(host: Column, path: Column, model: dict[str, Column], rest: Column | None = None) -> Column:
    """Mean over the characters of ln(accepted model / rejected model). model: the columns that train() makes; rest: the
    counts (a, r) by hash of the URL's grams that have no slot, null for none."""

    def step(o: int, c: Column, p: Column) -> Column:
        """Probabilities under order o. c: counts by order; p: probabilities of the characters after the start mark under order o-1."""
        here, before = c[o], c[o - 1]
        n = F.size(here)
        pairs = F.zip_with(here, F.slice(before, 1, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        # a gram that stayed where its context didn't counts for no more than the context
        longer = F.zip_with(pairs, F.slice(p, o, F.size(p)), lambda x, q: (F.least(x["a"], x["b"]) + STRENGTH * q) / (x["b"] + STRENGTH))
        return F.when(n > 0, F.concat(F.slice(p, 1, o - 1), longer)).otherwise(p)

    def logs(counted: Column, total: Column) -> Column:
        def chain(c: Column) -> Column:
            p = F.transform(F.slice(c[0], 2, F.size(c[0])), lambda x: (x + 1.0) / (total + ALPHABET))
            for o in range(1, ORDERS):
                p = let(p, partial(step, o, c))
            return F.aggregate(p, F.lit(0.0), lambda s, x: s + F.ln(x))

        return let(counted, chain)

    kind = "struct<a: double, r: double>"
    none = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("r"))

    def counts(h: Column) -> Column:
        """How often this gram came in accepted and in rejected URLs."""

        def at(k: Column) -> Column:
            found = F.when(k > 0, F.struct(*[F.element_at(model[c], F.greatest(k, F.lit(1))) for c in ("accept", "reject")]).cast(kind))
            if rest is not None:
                found = found.when((k < 0) & rest.isNotNull(), F.coalesce(F.try_element_at(rest, h).cast(kind), none))
            return found.otherwise(none)

        return let(place(h, model), at)

    def both(chars: Column) -> Column:
        counted = F.transform(F.array(*_grams(chars)), lambda order: F.transform(order, counts))
        of = lambda s, x: F.transform(s, lambda order: F.transform(order, lambda e: e[x]))
        return let(counted, lambda s: (logs(of(s, "a"), model["accepted"]) - logs(of(s, "r"), model["rejected"])) / F.greatest(F.size(chars) - 1, F.lit(1)))

    return let(_marked(host, path), both)


def cut_of(held: DataFrame) -> DataFrame:
    """(cut): the score from which on to accept, from (verdict, score) of decided URLs.

    Of the bounds between steps, that with the least sum of the shares rejected among accepted URLs and accepted among
    rejected ones; the middle of them, if several are next to each other. Either kind missing: 0.
    """
    most = int(SCORE_MOST / SCORE_STEP)
    place = F.greatest(F.least(F.floor(F.col("score") / SCORE_STEP), F.lit(most)), F.lit(-most)).cast("int")
    bins = held.groupBy(place.alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    bins = held.sparkSession.range(-most, most + 2).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").na.fill(0)  # some 2000 rows
    below, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    x = bins.select("bin", F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("kept_out"), F.sum("a").over(all_).alias("a"), F.sum("r").over(all_).alias("r"))
    x = x.where("a > 0 AND r > 0").withColumn("wrong", F.col("lost") / F.col("a") + 1 - F.col("kept_out") / F.col("r"))
    best = x.agg(F.min(F.struct("wrong", "lost")).alias("b"))
    ties = x.withColumn("b", best.scalar()).where("wrong = b.wrong AND lost = b.lost")
    return ties.agg(F.coalesce((F.min("bin") + F.max("bin")) / 2 * SCORE_STEP, F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url).

    A rule decides where one fits; the models decide the rest. Null url, or one without ://: host and path are empty,
    no rule fits, and the models judge the empty string. Repeated rows are judged alike, each by itself. Where no rule
    accepts, or none rejects, anything, scores are 0 and the verdict of what no rule decides is allow. Empty table: empty.
    """
    x = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumns({"rule": rule, "ruled": verdict})
    decided = x.where("ruled IS NOT NULL").select("host", "path", F.col("ruled").alias("verdict"))
    aside = F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATE_ONE_IN)) == 0
    model, rest = fitted(decided.where(~aside))
    model = written(model, "url-model")
    # The model is one value for all rows. Columns that the score mentions once, like it and ruled here, are taken into the
    # score by the optimizer, and a lambda's variable refers to them; a model that stays a column is copied into each row.
    whole = model.select(F.struct(*MODEL)).scalar()
    of = lambda z: {c: z["model"][c] for c in MODEL}
    # what the slots don't hold, for each distinct URL that is scored
    urls = x.where(F.col("ruled").isNull() | aside).select("host", "path").distinct().withColumn("model", whole)
    asked = urls.select("host", "path", let(F.struct("model"), lambda z: unplaced(F.col("host"), F.col("path"), of(z))).alias("h")).select("host", "path", F.explode("h").alias("h"))
    got = asked.join(rest, "h").groupBy("host", "path").agg(F.map_from_entries(F.collect_list(F.struct("h", F.struct("a", "r")))).alias("rest"))
    got = written(got, "url-rest-counts")
    scored = lambda z: ratio(F.col("host"), F.col("path"), of(z), z["rest"])
    held = decided.where(aside).join(got, ["host", "path"], "left").withColumn("model", whole).select("verdict", let(F.struct("model", "rest"), scored).alias("score"))
    cut = written(cut_of(held), "url-cut")
    judged = let(F.struct("ruled", "model", "rest"), lambda z: F.struct(z["ruled"].alias("ruled"), F.when(z["ruled"].isNull(), scored(z)).alias("score")))
    out = x.join(got, ["host", "path"], "left").withColumn("model", whole).select("page_id", "host", "path", "rule", judged.alias("judged")).select("page_id", "host", "path", "rule", "judged.*")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block")).alias("verdict"), "score")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, as the query's contract has it."""
    return judge(table(spark, sf_dir, "pages"))
