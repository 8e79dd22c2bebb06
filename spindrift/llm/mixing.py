"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's target over its size.
The whole part is taken as it is. The fractional parts are rounded together: of two documents one gives
words to the other, which and how many being drawn so that neither's expectation changes, until one of
the two is certain (1) or impossible (0); the other carries the rest on. The words of a source are thus
kept at every step. Documents meet others of like size in buckets first; each bucket leaves one
residual, and residuals are combined level by level until one is left for each source. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, free

#: Weights of the sources in their order, repeating; what they share, in words, as a part of all words;
#: the most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that one task pairs in a row; how many residuals meet in a task of the next level.
BUCKET, FAN_IN = 512, 64
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text: runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, size) rows: source, source_size, n_docs, target.

    Sources by code point, null last, have the weights in turn. Each gets share * all words by its
    weight, but `most` times its own words at most; the excess goes to the others by weight until none
    is above. That level is found at once: in the order in which sources fill up, the first one that
    the mass left over by those before it doesn't fill shows it.

    One row for each source is ordered by one task; documents are not.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fills = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fills.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns(
        {
            "cap_before": F.sum("cap").over(upto) - F.col("cap"),
            "weight_left": F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"),
            "all_words": F.sum("source_size").over(every),
        }
    )
    level = (F.lit(float(share)) * F.col("all_words") - F.col("cap_before")) / F.col("weight_left")
    per = per.withColumn("level", level).withColumn("open", F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level")))
    per = per.withColumn("final", F.first("open", ignorenulls=True).over(fills.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _draw(seed: int, a: Column, b: Column) -> Column:
    """A number in [0, 1) that a pair of documents always gets."""
    return F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _settle(p: Column) -> Column:
    return F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)


def _pivot(rows: Column, seed: int) -> Column:
    """Fold an array of struct(size, id, p), largest first: struct(cur, up), the residual (null at first,
    settled if its p is 0 or 1) and the ids that became certain before it."""
    item = "struct<size:bigint,id:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("cur"), F.array().cast("array<bigint>").alias("up"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["id"].alias("id"), p.alias("p")).cast(item)

    def step(acc: Column, x: Column) -> Column:
        cur, up = acc["cur"], acc["up"]
        a, p, b, q = cur["size"], cur["p"], x["size"], x["p"]
        gain, give = F.least((1 - p) * a, q * b), F.least(p * a, (1 - q) * b)  # words to cur, or from it
        to_cur = _draw(seed, cur["id"], x["id"]) * (gain + give) < give
        new_p = _settle(F.when(to_cur, F.when((1 - p) * a <= q * b, F.lit(1.0)).otherwise(p + gain / a)).otherwise(F.when(p * a <= (1 - q) * b, F.lit(0.0)).otherwise(p - give / a)))
        new_q = _settle(F.when(to_cur, F.when(q * b <= (1 - p) * a, F.lit(0.0)).otherwise(q - gain / b)).otherwise(F.when((1 - q) * b <= p * a, F.lit(1.0)).otherwise(q + give / b)))
        moved = F.struct(with_p(cur, new_p).alias("cur"), with_p(x, new_q).alias("x"))

        def after(m: Column) -> Column:
            done = (m["cur"]["p"] <= 0) | (m["cur"]["p"] >= 1)
            settled, stays = F.when(done, m["cur"]).otherwise(m["x"]), F.when(done, m["x"]).otherwise(m["cur"])
            return F.struct(stays.alias("cur"), F.when(settled["p"] >= 1, F.concat(up, F.array(settled["id"]))).otherwise(up).alias("up"))

        return (
            F.when(cur.isNull(), F.struct(x.cast(item).alias("cur"), up.alias("up")))
            .when(p <= 0, F.struct(x.cast(item).alias("cur"), up.alias("up")))
            .when(p >= 1, F.struct(x.cast(item).alias("cur"), F.concat(up, F.array(cur["id"])).alias("up")))
            .otherwise(F.element_at(F.transform(F.array(moved), after), 1))
        )

    return F.aggregate(F.reverse(F.array_sort(rows)), start, step)


def pivotal(chances: DataFrame, *, seed: int = 0, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """Ids (column id) that the rounding makes certain, from rows (stratum, n_docs, size, id, p).

    Strata are rounded apart, and each one's sum of p * size is kept to less than one document. n_docs is the
    stratum's number of rows. A bucket is a class of sizes within an eighth of an octave, dealt over as
    many parts as keep it near `bucket` rows; so a stratum of any size takes many tasks, and a task
    holds a few buckets. Reruns agree: draws are hashes of the ids.
    """
    octave = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")
    open_ = chances.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).withColumn("octave", octave)
    parts = F.greatest(F.ceil(F.col("n_docs") / float(bucket) / 8), F.lit(1))
    keyed = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id"), parts.cast("long")))
    item = F.struct("size", "id", "p")
    level = (
        keyed.groupBy("stratum", "octave", "part")
        .agg(F.collect_list(item).alias("items"))
        .select("stratum", "octave", "part", _pivot(F.col("items"), seed).alias("out"))
    )
    level = durable(level)
    sure = [level.select(F.explode("out.up").alias("id"))]
    left = level.select("stratum", "octave", "part", "out.cur").filter("cur.p > 0 and cur.p < 1")
    sure.append(level.filter("out.cur.p >= 1").select(F.col("out.cur.id").alias("id")))
    widest = chances.agg(F.max(F.ceil(F.col("n_docs") / float(bucket) / 8))).first()[0] or 1
    k = 1
    while True:
        # parts of an octave first meet each other, a fan-in at a time; then the octaves of a stratum
        last = widest <= 1
        keys = ["stratum"] if last else ["stratum", "octave", "part"]
        left = left if last else left.withColumn("part", F.floor(F.col("part") / fan_in))
        level = durable(
            left.groupBy(*keys).agg(F.collect_list("cur").alias("items")).select(*keys, _pivot(F.col("items"), seed + k).alias("out"))
        )
        sure.append(level.select(F.explode("out.up").alias("id")))
        sure.append(level.filter("out.cur.p >= 1").select(F.col("out.cur.id").alias("id")))
        left = level.select(*keys, "out.cur").filter("cur.p > 0 and cur.p < 1")
        if last:
            break
        widest, k = -(-widest // fan_in), k + 1
    # the one residual of a stratum goes where its source's words come nearest to their sum
    sure.append(left.filter("cur.p >= 0.5").select(F.col("cur.id").alias("id")))
    out = sure[0]
    for more in sure[1:]:
        out = out.unionByName(more)
    return out


def mix_sizes(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """From rows (id, source, size), of which no id is null: all their columns, source_size, target, copies."""
    targets = durable(source_targets(sizes, weights=weights, share=share, most=most))
    rows = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(want + EPS)
    rows = rows.withColumn("whole", whole).withColumn("p", _settle(F.greatest(want - whole, F.lit(0.0))))
    chances = rows.filter("size > 0").select(F.xxhash64("source").alias("stratum"), "n_docs", "size", "id", "p")
    sure = pivotal(chances, seed=seed).groupBy("id").agg(F.count(F.lit(1)).alias("more")).withColumnRenamed("id", "_i")
    return rows.join(sure, F.col("id") == F.col("_i"), "left").select(
        *sizes.columns, "source_size", "target", (F.col("whole") + F.least(F.coalesce("more", F.lit(0)), F.lit(1))).cast("int").alias("copies")
    )


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """What a document is rounded and joined by, never null: its id, or else a hash of its source and text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(source_col).cast("string"), F.col(text_col)))


def _mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """mix_sizes() of docs: id is the key, doc the id."""
    sizes = durable(
        docs.select(
            _key(id_col, text_col, source_col).alias("id"), F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
        )
    )
    return mix_sizes(sizes, weights=weights, share=share, most=most, seed=seed)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix of docs: id_col, size, source_size, target, copies, taken (copies * size).

    Options: weights, share, most, seed, id_col, text_col, source_col. A null or empty text has size 0
    and is never taken; a null source is a source, the last one. Ids are taken as unique; rows that share
    one share its rounding. Rows without an id are told apart by source and text. Documents of a source
    are all wanted equally. An empty table gives no rows.
    """
    return _mix(docs, **options).select(
        F.col("doc").alias(options.get("id_col", "doc_id")), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it: not at all, once or more, all columns kept.

    Options are those of mix(). A document of size 0 holds no words and isn't taken. Rows that share an id
    are taken as often as the one of them that is taken most.
    """
    key = _key(*(options.get(k, k.replace("id_col", "doc_id").replace("_col", "")) for k in ("id_col", "text_col", "source_col")))
    own, other, copies, turn = (free(x, docs.columns) for x in ("key", "id", "copies", "turn"))
    plan = _mix(docs, **options).filter("copies > 0").groupBy("id").agg(F.max("copies").alias(copies)).withColumnRenamed("id", other)
    joined = docs.withColumn(own, key).join(plan, F.col(own) == F.col(other))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
