"""Exact n-gram Jaccard join by set-relation skipping.

Sets of word n-grams are ordered by one order of all n-grams, common ones last, and keys made of the
first few of each are posted: runs of SPAN n-grams that stand next to each other in the set's order. Two
sets that are similar enough share so many n-grams, and the others are so few, that somewhere among the
first places no other stands between two shared ones; that run is a key of both (_last). Unlike single
n-grams, such keys are hardly ever shared by texts that have no more than a passage in common.

Most candidates are answered by derivation. Each set elects a pivot, the set that leads most of its
keys' lists, a list's leader being the entry that stands in most lists of all. A family is a pivot and
those that elect it; each member's overlap with the pivot is computed once, with their symmetric
difference. From these the overlap of any two members follows exactly: it is what the pivot leaves after
both differences, and what the differences share comes on top. So two members of which one doesn't link
with the pivot can only link if their differences have at least so much in common, and differences are
joined by prefixes in turn, rare n-grams first. Members that link with the pivot are in its class already.

What is left are list entries of different families. Those that known links have brought into one class
are skipped, whole lists at once, as are entries whose places or sizes are out of each other's reach; the
others are compared. No candidate is dropped undecided.

Equal sets are one set, named by a 64-bit digest, from the posting on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP, batches, byte_runs, durable, free, mixed, number_batches, slices, small_batches, stored, thin, word_hashes
from .graph import components

#: How many common n-grams the order knows of (a bound of what is broadcast; it changes the work, not the
#: result), and from which part of a task's documents on one counts as common.
COMMON, PART = 1 << 16, 0.002
#: N-grams that a task counts at once, and digests that a task remembers as posted.
COUNT_AT_ONCE, POSTED = 1 << 20, 1 << 15
#: A member of a family has at least this similarity to its pivot, in percent; others are on their own.
KIN = 33
#: So many ids at most are sent to all tasks that look documents up; with more, both sides are shuffled.
SENT_IDS = 1 << 18
#: Parts that a hot class's documents are dealt to.
SALTS = 16


def ngram_sets(raw: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, hashed: hashes sorted within each text, and where each text's begin.
    A text of fewer words is one n-gram, its whole sequence; one without words has none."""
    h, owner, _ = word_hashes(raw, starts)
    docs = len(starts) - 1
    # independent of each other, or words in another order could have the same sum
    weights = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)
    words = np.bincount(owner, minlength=docs)
    first = np.concatenate([[0], np.cumsum(words)])
    sums = h[: max(0, len(h) - n + 1)] * weights[0]
    for k in range(1, n):
        sums += h[k : len(h) - n + 1 + k] * weights[k]
    sums = mixed(sums + np.uint64(n))
    found = []
    for d in range(docs):
        w, f = int(words[d]), int(first[d])
        if w >= n:
            grams = np.sort(sums[f : f + w - n + 1])
            new = np.ones(len(grams), bool)
            np.not_equal(grams[1:], grams[:-1], out=new[1:])
            found.append(grams[new])
        elif w:
            whole = sum(int(h[f + k]) * int(weights[k]) for k in range(w)) + w
            found.append(mixed(np.array([whole & (2**64 - 1)], np.uint64)))
        else:
            found.append(h[:0])
    return np.concatenate(found) if found else h[:0], np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def _digests(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each set that doesn't depend on order (0 for empty sets)."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    return mixed(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64)) * (np.diff(begin) > 0)


def _need(n, m, num: int, den: int):
    """The overlap that sets of sizes n and m need."""
    return -(-num * (n + m) // (num + den))


def _span(num: int, den: int) -> int:
    """N-grams in a key. Runs of two are shared by all linked sets if the similarity is 3/4 or more:
    from 7 n-grams in both together on, there are more shared ones than gaps that others can break, and
    smaller sets link only if they are equal."""
    return 2 if 4 * num >= 3 * den else 1


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass over all texts: rows (doc, id, size, mark) and, doc being false, rows of n-grams that are
    common in a part of the table (id: the n-gram, size: in how many documents)."""

    def common(parts: list[np.ndarray], seen: int, out: dict[int, int]) -> None:
        if parts:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            often = counts >= max(4, PART * seen)
            for v, c in zip(values[often].tolist(), counts[often].tolist(), strict=True):
                out[v] = out.get(v, 0) + c

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen, often = [], 0, 0, {}
        for batch in batches(it):
            grams, begin = ngram_sets(*byte_runs(batch), n)
            yield _rows(np.ones(batch.num_rows, bool), batch.column(0), np.diff(begin), _digests(grams, begin))
            parts.append(grams)
            held, seen = held + len(grams), seen + batch.num_rows
            if held >= COUNT_AT_ONCE:
                common(parts, seen, often)
                parts, held, seen = [], 0, 0
        common(parts, seen, often)
        keys = np.fromiter(often, np.uint64, len(often))
        yield _rows(np.zeros(len(often), bool), pa.array(keys.view(np.int64)), np.fromiter(often.values(), np.int64, len(often)), np.zeros(len(often), np.uint64))

    def _rows(doc, ids, size, mark) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), ids, pa.array(size.astype(np.int64)), pa.array(mark.view(np.int64))], names=["doc", "id", "size", "mark"])

    return docs.mapInArrow(run, "doc boolean, id long, size long, mark long")


def _postings(docs: DataFrame, n: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (gram, size, mark, place) of the keys that each set posts: those that stand early enough to be
    the first shared with its smallest partner.

    Of all n-grams of two linked sets in order, n - need and m - need at most aren't shared. A run of two
    shared ones is broken only by one of those, so after as many shared n-grams the next two form a run:
    the last place of their first one in the set of size n is n - need + (span - 1)(n + m - 2 need).
    """
    spark, span = docs.sparkSession, _span(num, den)
    shipped = spark.sparkContext.broadcast(common)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, freq = shipped.value
        posted: set[int] = set()  # to save work: equal sets that are posted again are merged in the lists
        for batch in batches(it):
            grams, begin = ngram_sets(*byte_runs(batch), n)
            size, marks = np.diff(begin), _digests(grams, begin)
            fresh = np.zeros(len(size), bool)
            for d, mark in enumerate(marks.tolist()):
                if size[d] and mark not in posted:
                    posted.add(mark)
                    fresh[d] = True
            if len(posted) > POSTED:
                posted.clear()
            of = np.repeat(np.arange(len(size)), size)
            keep = fresh[of]
            grams, of = grams[keep], of[keep]
            if not len(grams):
                continue
            often = np.zeros(len(grams), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                often = np.where(keys[at] == grams, freq[at], 0)
            order = np.argsort(of * (int(often.max()) + 1) + often, kind="stable")  # equally common ones by hash
            grams = grams[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            m = size[of]
            use = place <= np.minimum(span * (den - num) * m // den, m - span)
            keyed = mixed(grams * np.uint64(STEP) + np.append(grams[1:], grams[:1])) if span > 1 else grams
            yield pa.RecordBatch.from_arrays(
                [pa.array(keyed[use].view(np.int64)), pa.array(m[use].astype(np.int32)), pa.array(marks[of[use]].view(np.int64)), pa.array(place[use].astype(np.int32))],
                names=["gram", "size", "mark", "place"],
            )

    return docs.mapInArrow(run, "gram long, size int, mark long, place int")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of keys that different sets share, each set's once. Lists are streamed in order, so
    that none need be held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, listed = None, False  # the last row so far, and whether another stands before it in its list
        for batch in batches(it):
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            gram, _, mark, _ = columns
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (mark[1:] != mark[:-1])
            columns = [c[fresh] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            many = np.zeros(len(columns[0]), bool)
            many[1:] |= same
            many[:-1] |= same
            many[0] |= listed
            held, listed = [c[-1:] for c in columns], bool(many[-1])
            many[-1] = False
            yield _rows([c[many] for c in columns])
        if held is not None and listed:
            yield _rows(held)

    def _rows(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "size", "mark", "place"])

    lists = postings.repartition(slices(postings.sparkSession), "gram").sortWithinPartitions("gram", "mark")
    return lists.mapInArrow(run, "gram long, size int, mark long, place int")


def _pivots(entries: DataFrame) -> DataFrame:
    """Rows (mark, pivot): for each set the leader of most of its lists; a list's leader is the entry that
    stands in most lists."""
    degree = entries.groupBy(F.col("mark").alias("m")).agg(F.count(F.lit(1)).alias("degree"))
    leaders = entries.join(degree, F.col("mark") == F.col("m")).groupBy(F.col("gram").alias("g")).agg(F.max(F.struct("degree", "mark")).alias("x"))
    votes = entries.join(leaders.select("g", F.col("x.mark").alias("leader")), F.col("gram") == F.col("g")).groupBy("mark", "leader").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("mark").agg(F.max(F.struct("n", "leader")).alias("x")).select("mark", F.col("x.leader").alias("pivot"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sets ga, gb, sizes n, m and overlap o."""
    one = pairs.join(sets.select(F.col("mark").alias("x"), F.col("grams").alias("ga")), F.col("a") == F.col("x")).drop("x")
    two = one.join(sets.select(F.col("mark").alias("y"), F.col("grams").alias("gb")), F.col("b") == F.col("y")).drop("y")
    return two.select("*", F.size("ga").cast("long").alias("n"), F.size("gb").cast("long").alias("m"), F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))


def _linked(num: int, den: int) -> F.Column:
    return (num + den) * F.col("o") >= num * (F.col("n") + F.col("m"))


def _derived(kin: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of one family of which not both link with the pivot, from rows
    (mark, pivot, p, n, o, linked, differs): sizes of pivot and member, their overlap, whether that links
    them, and the symmetric difference.

    Let a member lack d of the pivot's n-grams and have e others. The overlap of two members is
    p - d - d' + what their differences share, and it links them if (num + den) * shared is at least
    w + w' - (den - num) * p with w = den * d + num * e; alike, a member links with the pivot if
    w <= (den - num) * p. So, one of the two not being linked with it, they share 1 at least.
    """
    both, gap = num + den, (den - num) * F.col("p")
    kin = kin.withColumn("d", F.col("p") - F.col("o")).withColumn("e", F.col("n") - F.col("o")).withColumn("w", den * F.col("d") + num * F.col("e"))
    families = kin.groupBy(F.col("pivot").alias("f")).agg(F.min("w").alias("w_all"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("w_out")).filter("w_out is not null")
    members = kin.join(families, F.col("pivot") == F.col("f")).drop("f")
    scalars = ("mark", "pivot", "p", "d", "e", "w", "linked", "w_all", "w_out")
    each = members.select(*scalars, F.explode("differs").alias("gram"))
    often = each.groupBy(F.col("pivot").alias("f"), F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # those that no other member has come first and need no posting; the others follow, rare ones first
    ordered = each.join(often, (F.col("pivot") == F.col("f")) & (F.col("gram") == F.col("g"))).groupBy(*scalars).agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("shared"))
    posts = ordered.select(*scalars, (F.col("d") + F.col("e")).alias("x"), F.size("shared").alias("k"), F.posexplode("shared").alias("place", "y"))
    posts = posts.withColumn("place", F.col("x") - F.col("k") + F.col("place"))
    least = lambda other: F.ceil((F.col("w") + other - gap) / both)
    posts = posts.filter(F.col("place") <= F.col("x") - least(F.when(F.col("linked"), F.col("w_out")).otherwise(F.col("w_all"))))
    posts = posts.select("pivot", F.col("y.gram").alias("gram"), "mark", "p", "d", "e", "w", "x", "place", "linked", (F.col("place") <= F.col("x") - least(F.col("w_out"))).alias("early"))
    posts = stored(posts)

    one = posts.filter("not linked").alias("i")
    two = posts.alias("j")
    least_shared = F.col("i.w") + F.col("j.w") - (den - num) * F.col("i.p")
    met = (
        (F.col("i.pivot") == F.col("j.pivot")) & (F.col("i.gram") == F.col("j.gram"))
        & (F.col("j.linked") | ((F.col("i.mark") < F.col("j.mark")) & F.col("i.early") & F.col("j.early")))
        & (both * (F.col("i.x") - F.col("i.place")) >= least_shared) & (both * (F.col("j.x") - F.col("j.place")) >= least_shared)
        & (both * (F.least("i.d", "j.d") + F.least("i.e", "j.e")) >= least_shared)
    )
    pairs = one.join(two, met).select(F.col("i.mark").alias("a"), F.col("j.mark").alias("b")).distinct()
    side = lambda c: kin.select(F.col("mark").alias(f"m{c}"), F.col("w").alias(f"w{c}"), F.col("differs").alias(f"x{c}"), *([F.col("p")] if c == "a" else []))
    tried = pairs.join(side("a"), F.col("a") == F.col("ma")).join(side("b"), F.col("b") == F.col("mb"))
    return tried.filter(both * F.size(F.array_intersect("xa", "xb")) >= F.col("wa") + F.col("wb") - gap).select("a", "b")


def _across(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b) of different families and classes, from rows (gram, size, mark, place, family,
    class). A list's entries of its largest family are never held against each other."""
    span = _span(num, den)
    lists = entries.groupBy(F.col("gram").alias("g")).agg(F.min("family").alias("fl"), F.max("family").alias("fh"), F.min("class").alias("cl"), F.max("class").alias("ch"))
    open_ = entries.join(lists.filter("fl < fh and cl < ch").select("g"), F.col("gram") == F.col("g"), "left_semi")
    most = open_.groupBy("gram", "family").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("gram").alias("g")).agg(F.max(F.struct("c", "family")).alias("x"))
    told = open_.join(most.select("g", F.col("x.family").alias("top")), F.col("gram") == F.col("g")).drop("g").withColumn("main", F.col("family") == F.col("top"))
    told = stored(told)
    i, j = told.filter("not main").alias("i"), told.alias("j")
    need = F.ceil(num * (F.col("i.size") + F.col("j.size")) / (num + den))
    spare_i, spare_j = F.col("i.size") - need, F.col("j.size") - need
    fits = (
        (F.col("i.gram") == F.col("j.gram")) & (F.col("i.family") != F.col("j.family")) & (F.col("i.class") != F.col("j.class"))
        & (F.col("j.main") | (F.col("i.mark") < F.col("j.mark")))
        & (F.col("i.size") * den >= num * F.col("j.size")) & (F.col("j.size") * den >= num * F.col("i.size"))
        & (F.col("i.place") <= spare_i + (span - 1) * (spare_i + spare_j)) & (F.col("j.place") <= spare_j + (span - 1) * (spare_i + spare_j))
        & (F.col("i.place") - F.col("j.place") <= spare_i) & (F.col("j.place") - F.col("i.place") <= spare_j)
    )
    return i.join(j, fits).select(F.least("i.mark", "j.mark").alias("a"), F.greatest("i.mark", "j.mark").alias("b")).distinct()


def ngram_join(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose sets of word n-grams have a Jaccard similarity of num / den or more:
    id_col, n_shingles (the set's size) and component_id (the smallest id reachable by links).

    Words are runs of other characters than ASCII white space, A-Z lower-cased. A text of fewer than n
    words is one n-gram; a null text, or one without words, has an empty set and links with nothing. Ids
    are integers, taken as unique; rows that share one are linked as one document, and each is returned;
    a null id is returned as its own class. Equal sets always link. n-grams are compared by 64-bit hashes,
    equal sets are told by a 64-bit digest. Other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known_ids = base.filter("id is not null")
    survey = stored(_survey(base, n))
    per_doc = survey.filter("doc").select("id", "size", "mark")
    full = per_doc.filter("size > 0 and id is not null")
    named = full.groupBy("mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    top = survey.filter("not doc").groupBy("id").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "id").limit(COMMON).collect()
    keys, freq = np.array([r["id"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(keys)

    postings = _postings(known_ids, n, num, den, (keys[order], freq[order]))
    entries = stored(_shared(postings))
    elected = stored(thin(_pivots(entries)))
    direct = elected.filter("mark <> pivot").select(F.col("mark").alias("a"), F.col("pivot").alias("b"))
    differs = F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga"))
    told = stored(_with_sets(direct, _sets_of(direct, known_ids, named, n)).withColumn("near", 100 * F.col("o") >= KIN * (F.col("n") + F.col("m") - F.col("o"))).select(
        "a", "b", "n", "m", "o", _linked(num, den).alias("linked"), "near", F.when(F.col("near"), differs).alias("differs")))
    kin = told.filter("near").select(F.col("a").alias("mark"), F.col("b").alias("pivot"), F.col("m").alias("p"), "n", "o", "linked", "differs")
    links = durable(thin(told.filter("linked").select("a", "b").unionByName(_derived(kin, num, den))))

    classes = durable(thin(components(links).select(F.col("id").alias("i"), "component")))
    family = kin.select(F.col("mark").alias("k"), "pivot")
    placed = entries.join(family, F.col("mark") == F.col("k"), "left").join(classes, F.col("mark") == F.col("i"), "left")
    placed = placed.select("gram", "size", "mark", "place", F.coalesce("pivot", "mark").alias("family"), F.coalesce("component", "mark").alias("class"))
    known = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(thin(_across(placed, num, den).join(known, ["a", "b"], "left_anti")))
    late = _with_sets(more, _sets_of(more, known_ids, named, n)).filter(_linked(num, den)).select("a", "b")

    # rows of one id are one document
    twice = full.groupBy(F.col("id").alias("t")).agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo < hi")
    same_id = full.join(twice, F.col("id") == F.col("t")).filter("mark <> lo").select(F.col("mark").alias("a"), F.col("lo").alias("b"))
    final = durable(thin(components(durable(thin(links.unionByName(late).unionByName(same_id))))))
    named = named.join(final, F.col("mark") == F.col("id"), "left").drop("id").filter("component is not null or copies > 1").withColumn("component", F.coalesce("component", "mark"))
    named = stored(thin(named))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("first"))
    found = named.join(least, F.col("component") == F.col("c")).select(F.col("mark").alias("m"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = per_doc.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return dealt.join(found, (F.col("mark") == F.col("m")) & (F.col("s") == F.col("salt")) & (F.col("size") > 0) & F.col("id").isNotNull(), "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("first", "id").alias("component_id")
    )


def _sets_of(pairs: DataFrame, docs: DataFrame, named: DataFrame, n: int) -> DataFrame:
    """The sets (mark, grams) that a pair names, from one document of each. Their ids are sent to the
    documents where they are few; otherwise both sides are shuffled."""
    marks = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    ids = stored(named.join(marks, F.col("mark") == F.col("w"), "left_semi").select(F.col("rep").alias("w")).distinct().transform(thin))
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    return stored(_sets(docs.join(ids, F.col("id") == F.col("w"), "left_semi").select("text"), n).dropDuplicates(["mark"]))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            grams, begin = ngram_sets(*byte_runs(batch), n)
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(grams, begin).view(np.int64)), lists], names=["mark", "grams"])

    return docs.mapInArrow(run, "mark long, grams array<long>")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that another document of their class stands for: of each class the row with the
    smallest id stays, and rows without an id."""
    found = ngram_join(docs, id_col=id_col, **options)
    gone = free("lost", docs.columns)
    lost = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(lost, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
