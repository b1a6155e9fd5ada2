"""Exact n-gram Jaccard join with grouped prefixes, down to connected components.

1. A text's set is its distinct n-word shingles (64-bit hashes). Shingles are ordered from rare to
   frequent by a level that is a fixed function of the shingle (``repeats.Repeats.level``), then by
   hash. Two sets that link share a shingle among their first ``n - ceil(t * n) + 1`` (the prefix).
   Prefix shingles that occur in one document only can't be shared and are left out; so
   are sets of which too few shingles occur in any other document.
2. Rows with equal sets are one node. Nodes with the same size and prefix are one group.
3. Groups meet on prefix shingles; group pairs must pass the length filter, the position filter and
   a bound from what their whole prefixes share, and are then expanded to nodes and verified on
   the whole sets.
4. Only reachability is asked for, so nodes that are already in one component need not be compared:
   a first round compares each group with the one leader of its shingles that it shares most of
   them with (and the nodes of a group with its first), a second one compares groups with other
   leaders in components that they are still apart from, and the last round takes all pairs that are still in
   different components. The leaders of the first round are the groups with the smallest part of shingles
   of their own: a text with little that its near copies have not stands in their middle. In the last round only groups
   outside the component that most groups of a shingle are in meet all others, and sketches of the sets bound
   what two groups can share before they make a pair. No link between different components is left out, and
   thousands of near copies cost a few comparisons each instead of one for each pair.

Every table between rounds is written below ``spark.checkpoint.dir``.

Defined results: null or empty texts have no shingles and are their own component. Rows with a null
doc_id take part; a component's id is its smallest doc_id that is not null (null if there is
none). Repeated rows share a component. Empty tables give no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphvec.llm.components import components
from graphvec.llm.repeats import Repeats, find_repeats
from graphvec.llm.text import blobs, mix, pieces, shingles, word_hashes, words
from graphvec.session import write_table

WORDS, SIMILARITY = 5, 0.75


def _sets(b: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    for x in blobs(b.column("text")):
        yield shingles(word_hashes(words(x.lower())), n)  # bytes.lower is A-Z only


def signatures(docs: DataFrame, t: Fraction, n: int) -> DataFrame:
    """One written row a document: doc_id, text checksum, n, and for those that share a prefix
    shingle with another the signatures of the set and of its prefix, the prefix shingles that
    are shared, with their positions, and the sketch of the shingles that some other document may hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _crc().alias("crc"), "text")
    found = find_repeats(docs.select("text"), ["text"], lambda b: _sets(b, n))
    seen = rows.sparkSession.sparkContext.broadcast(found)
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols: list[list] = [[] for _ in kinds]
            for s in _sets(b, n):
                for c, v in zip(cols, _signature(s, seen.value, t), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("crc"), *(pa.array(c, x) for c, x in zip(cols, kinds, strict=True))],
                ["doc_id", "crc", "n", "most", "sig", "sig2", "psig", "toks", "pos", "bits"],
            )

    schema = "doc_id long, crc long, n long, most long, sig long, sig2 long, psig long, toks array<long>, pos array<int>, bits array<long>"
    out = rows.mapInArrow(run, schema)
    del found
    written = write_table(out.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    seen.destroy()  # the table is written, nothing reads the filter again
    return written


def _signature(s: np.ndarray, seen: Repeats, t: Fraction) -> tuple:
    size = len(s)
    need = -(-size * t.numerator // t.denominator)
    level = seen.level(s)
    s = s[np.lexsort((s, level))]
    head = s[: size - need + 1] if size else s
    repeated = seen.repeated(s)
    at = np.flatnonzero(repeated[: len(head)])
    most = int(repeated.sum())  # shingles that some other document may hold
    if not len(at) or most * t.denominator < size * t.numerator:
        return size, most, None, None, None, None, None, None
    sums = [np.bitwise_xor.reduce(s), mix(s).sum(dtype=np.uint64), mix(head).sum(dtype=np.uint64)]
    return (size, most, *np.array(sums, np.uint64).view(np.int64).tolist(), head[at].view(np.int64), at.astype(np.int32), _sketch(s[repeated]))


def _sketch(s: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` bits in 64-bit words; each value sets one."""
    bits = np.zeros(SKETCH_BITS, bool)
    bits[(mix(s) >> np.uint64(32)) % np.uint64(SKETCH_BITS)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def _met_shingles(live: DataFrame) -> DataFrame:
    """``live`` without prefix shingles that only one document has in its prefix."""

    def values(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        # the first in the order lie low: spread them over the blocks
        yield mix(b.column("toks").flatten().to_numpy(zero_copy_only=False).view(np.uint64))

    seen = live.sparkSession.sparkContext.broadcast(find_repeats(live, ["toks"], values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks, pos = [], []
            for x, p in zip(b.column("toks"), b.column("pos"), strict=True):
                x, p = x.values.to_numpy(zero_copy_only=False), p.values.to_numpy(zero_copy_only=False)
                at = seen.value.repeated(mix(x.view(np.uint64)))
                toks.append(x[at])
                pos.append(p[at])
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("n"), pa.array(toks, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32()))], ["gid", "n", "toks", "pos"])

    rows = live.select(F.col("rid").alias("gid"), "n", "toks", "pos")
    met = rows.mapInArrow(run, "gid long, n long, toks array<long>, pos array<int>").where(F.size("toks") > 0)
    met = write_table(met, "met")
    seen.destroy()  # the table is written, nothing reads the filter again
    return met


def _may_link(t: Fraction) -> Column:
    """Length and position filter of two groups that share a shingle (n, p, and the shingles ``m`` that
    others may hold, with a or b before)."""
    p, q = t.numerator, t.denominator
    length = (F.least("an", "bn") * q) >= (F.greatest("an", "bn") * p)
    most = 1 + F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) - 1
    return length & ((F.least(most, "am", "bm") * (p + q)) >= ((F.col("an") + F.col("bn")) * p))


#: Prefix shingles of a group that tell which of the shared ones makes a pair.
FIRST = 8
#: Bits of the sketch of a set (a multiple of 64). Larger sets than that share more of them and pass more pairs, never fewer.
SKETCH_BITS = 2048
#: What a null doc_id is fetched by.
NULL_KEY = -(1 << 63)
#: Nodes (24 bytes each) up to which the list of needed texts is sent to the scan of the documents; a longer one
#: is joined by a shuffle.
BROADCAST_NODES = 400_000


def _sketches_allow(t: Fraction) -> Column:
    """The similarity is within reach of two groups of one node each (sketches ``ak`` and ``bk`` with ``ac`` and ``bc`` bits): each
    bit that only one of them has stands for a shingle or more that the other one does not hold. Without a sketch it is."""
    p, q = t.numerator, t.denominator
    both = F.aggregate(F.zip_with("ak", "bk", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    most = F.least(F.col("am") - F.col("ac"), F.col("bm") - F.col("bc")) + both
    return F.coalesce((most * (p + q)) >= ((F.col("an") + F.col("bn")) * p), F.lit(True))


def _crc() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, t: Fraction, n: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity. The texts of nodes in ``pairs`` are
    fetched by doc_id and checksum, their sets made once, and each pair's sets met a row at a time."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "at"), "node")
    need = write_table(need.select("node", F.coalesce("at.doc_id", F.lit(NULL_KEY)).alias("key"), "at.crc"), "needed")
    few = F.broadcast(need) if need.count() <= BROADCAST_NODES else need
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), _crc().alias("crc"), "text")
    found = keyed.join(few, ["key", "crc"]).dropDuplicates(["key", "crc"])  # repeated rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = pa.array([x.view(np.int64) for x in _sets(b, n)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), sets], ["node", "set"])

    sets = write_table(found.select("node", "text").mapInArrow(run, "node long, set array<long>"), "sets")
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(same * t.denominator >= (F.size("sa") + F.size("sb") - same) * t.numerator).select("a", "b")


def join_components(docs: DataFrame, *, similarity: float = SIMILARITY, n: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    rows = _labelled(docs, similarity, n)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_doc", "doc_id").alias("component_id"))


def similarity_links(docs: DataFrame, *, similarity: float = SIMILARITY, n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The join's result, where ``join_components`` asks for reachability only: ``(a, b)``, every pair of
    classes of equal sets that reaches the similarity, and ``(rid, doc_id, n_shingles, node)``, the class of each row. A class
    is named by the smallest rid of its rows. Rows of one class (with shingles) link too. All candidate
    pairs are compared, so the work grows with the links of a group of near copies."""
    t = _fraction(similarity)
    sigs, nodes, members, heads, meet = _candidates(docs, t, n)
    meet = meet.join(heads.select("gid", F.slice("toks", 1, FIRST).alias("f")), "gid")
    one = meet.select("tok", *[F.col(c).alias(x) for c, x in (("gid", "ga"), ("n", "an"), ("p", "ap"), ("m", "am"), ("f", "fa"))])
    two = meet.select("tok", *[F.col(c).alias(x) for c, x in (("gid", "gb"), ("n", "bn"), ("p", "bp"), ("m", "bm"), ("f", "fb"))])
    made_first = F.coalesce(F.get(F.array_intersect("fa", "fb"), F.lit(0)) == F.col("tok"), F.lit(True))
    met = one.join(two, "tok").where((F.col("ga") < F.col("gb")) & _may_link(t) & made_first)
    met = _enough(met.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct(), heads, t)
    met = met.select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    own = members.select(F.col("gid").alias("ga"), F.col("gid").alias("gb")).distinct()
    a = members.select(F.col("gid").alias("ga"), F.col("node").alias("a"))
    b = members.select(F.col("gid").alias("gb"), F.col("node").alias("b"))
    pairs = met.unionByName(own).join(a, "ga").join(b, "gb").where((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b")))
    pairs = write_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    links = write_table(_verify(pairs, nodes, docs, t, n), "linked")
    keys = ["sig", "sig2", "n", "psig"]
    rows = sigs.select("rid", "doc_id", *keys).join(nodes.select(*keys, "node"), keys, "left")
    return links, rows.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("node", "rid").alias("node"))


def _fraction(similarity: float) -> Fraction:
    t = Fraction(similarity).limit_denominator(10_000)
    if not 0 < t <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    return t


def _candidates(docs: DataFrame, t: Fraction, n: int) -> tuple[DataFrame, ...]:
    """Signatures, nodes, members of groups, prefixes of groups, and a row for each prefix shingle that groups share."""
    sigs = signatures(docs, t, n)
    live = sigs.where(F.col("sig").isNotNull())
    at = F.min(F.struct("rid", "doc_id", "crc")).alias("at")
    nodes = live.groupBy("sig", "sig2", "n", "psig").agg(at, F.min("doc_id").alias("doc"), F.max("most").alias("most"))
    nodes = write_table(nodes.withColumn("node", F.col("at.rid")), "nodes")
    groups = write_table(nodes.groupBy("n", "psig").agg(F.min("node").alias("gid"), F.max("most").alias("m")), "groups")
    members = write_table(nodes.join(groups, ["n", "psig"]).select("node", "gid"), "members")
    # One row a prefix shingle and group; a group's first node stands for it.
    heads = write_table(_met_shingles(live).join(groups.select("gid", "m"), "gid"), "heads")
    meet = heads.select("gid", "n", "m", F.explode(F.arrays_zip("toks", "pos")).alias("z")).select(
        F.col("z.toks").alias("tok"), "gid", "n", F.col("z.pos").alias("p"), "m"
    )
    shared = meet.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok")
    return sigs, nodes, members, heads, write_table(meet.join(shared, "tok", "left_semi"), "prefixes")


def _labelled(docs: DataFrame, similarity: float, n: int) -> DataFrame:
    t = _fraction(similarity)
    sigs, nodes, members, heads, meet = _candidates(docs, t, n)

    # Round 1: each group meets the leader that it shares most shingles with, and its own nodes.
    own = F.struct((F.col("n") - F.col("m")) / F.col("n"), "gid")
    lead = meet.groupBy("tok").agg(F.min_by(F.struct("gid", "n", "p", "m"), own).alias("lead"))
    led = _against(meet.join(lead, "tok"), t).groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    led = _enough(led.select("a", "b"), heads, t)
    inside = members.where(F.col("node") != F.col("gid")).select(F.col("gid").alias("a"), F.col("node").alias("b"))
    pairs = write_table(led.select("a", "b").unionByName(inside), "pairs")
    links = write_table(_verify(pairs, nodes, docs, t, n), "linked")
    comp = write_table(_spread(nodes, links), "components")

    # Round 2: groups that are apart from some leader of theirs, chosen anew for each shingle, meet one in each such component.
    apart = _apart(meet, members, comp)
    lead = apart.groupBy("tok").agg(F.min_by(F.struct("gid", "n", "p", "m", "low"), F.xxhash64("tok", "gid")).alias("lead"))
    rows = apart.join(lead, "tok").where((F.col("low") != F.col("lead.low")) | (F.col("low") != F.col("high")))
    led = _against(rows, t, F.col("lead.low").alias("there")).groupBy("b", "there").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    some = F.struct(F.least("a", "b"), F.greatest("a", "b"))
    more = _enough(led.select("a", "b"), heads, t).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more = more.groupBy(some.alias("s")).agg(F.first("a").alias("a"), F.first("b").alias("b")).select("a", "b")
    tested = write_table(pairs.unionByName(more), "pairs")
    more = tested.join(pairs, ["a", "b"], "left_anti")
    found = _verify(more, nodes, docs, t, n)
    links = write_table(links.unionByName(found), "linked")
    comp = write_table(_spread(nodes, links), "components")

    # Round 3: all pairs that are still in different components and were not compared. Of two such groups one at least is
    # outside the main component of a shingle they share, so only these meet all groups of the shingle.
    # A pair that shares one of its first shingles is made by the first of these only.
    apart = _apart(meet, members, comp)
    main = apart.where("low = high").groupBy("tok", "low").agg(F.count(F.lit(1)).alias("c")).groupBy("tok").agg(F.max_by("low", F.struct("c", "low")).alias("main"))
    apart = apart.join(main, "tok", "left").withColumn("main", F.coalesce((F.col("low") == F.col("main")) & (F.col("low") == F.col("high")), F.lit(False)))
    apart = apart.join(_sketched(apart.select("gid").distinct(), members, heads, sigs), "gid")
    one = apart.where(~F.col("main")).select("tok", *[F.col(c).alias(x) for c, x in (("gid", "ga"), ("n", "an"), ("p", "ap"), ("m", "am"), ("low", "la"), ("high", "ha"), ("f", "fa"), ("k", "ak"), ("c", "ac"))])
    two = apart.select("tok", "main", *[F.col(c).alias(x) for c, x in (("gid", "gb"), ("n", "bn"), ("p", "bp"), ("m", "bm"), ("low", "lb"), ("high", "hb"), ("f", "fb"), ("k", "bk"), ("c", "bc"))])
    both = F.array_intersect("fa", "fb")
    differ_first = F.coalesce(F.get(both, F.lit(0)) == F.col("tok"), F.lit(True))
    differ = (F.col("la") != F.col("lb")) | (F.col("la") != F.col("ha")) | (F.col("lb") != F.col("hb"))
    once = (F.col("main") & (F.col("ga") != F.col("gb"))) | (F.col("ga") < F.col("gb"))
    met = one.join(two, "tok").where(once & differ & _may_link(t) & differ_first & _sketches_allow(t))
    met = _enough(met.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct(), heads, t).select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    ours = members.join(comp, "node").select("gid", "node", "comp")
    mixed = ours.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("gid")
    met = met.unionByName(mixed.select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
    a = ours.select(F.col("gid").alias("ga"), F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = ours.select(F.col("gid").alias("gb"), F.col("node").alias("b"), F.col("comp").alias("cb"))
    rest = met.join(a, "ga").join(b, "gb").where(F.col("ca") != F.col("cb"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = write_table(rest.join(known, ["a", "b"], "left_anti"), "pairs")
    links = write_table(links.unionByName(_verify(rest, nodes, docs, t, n)), "linked")
    comp = _spread(nodes, links)

    least = nodes.join(comp, "node")
    smallest = least.groupBy("comp").agg(F.min("doc").alias("least_doc"))
    named = least.join(smallest, "comp").select("sig", "sig2", "n", "psig", "comp", "least_doc")
    return sigs.select("rid", "doc_id", "crc", "n", "sig", "sig2", "psig").join(named, ["sig", "sig2", "n", "psig"], "left")


def _sketched(groups: DataFrame, members: DataFrame, heads: DataFrame, sigs: DataFrame) -> DataFrame:
    """``groups(gid)`` with the first shingles of their prefixes (f) and, where all rows of a group have one set, its sketch (k) and the
    number of its bits (c)."""
    single = members.groupBy("gid").agg((F.count(F.lit(1)) == 1).alias("single")).where("single")
    single = groups.join(single, "gid").join(sigs.select(F.col("rid").alias("gid"), F.col("bits").alias("k")), "gid")
    bits = F.aggregate(F.transform("k", F.bit_count), F.lit(0), lambda n, x: n + x)
    found = heads.select("gid", F.slice("toks", 1, FIRST).alias("f")).join(groups, "gid", "left_semi")
    return found.join(single.select("gid", "k", bits.alias("c")), "gid", "left")


def _against(rows: DataFrame, t: Fraction, *more: Column) -> DataFrame:
    """Each group with the leader of each of its shingles, where they may link: (a, b, shared)."""
    lead = F.col("lead")
    pairs = rows.select(
        lead.getField("gid").alias("a"), lead.getField("n").alias("an"), lead.getField("p").alias("ap"), lead.getField("m").alias("am"),
        F.col("gid").alias("b"), F.col("n").alias("bn"), F.col("p").alias("bp"), F.col("m").alias("bm"), *more,
    )
    names = [c for c in pairs.columns if c not in ("a", "b", "an", "ap", "am", "bn", "bp", "bm")]
    return pairs.where((F.col("a") != F.col("b")) & _may_link(t)).groupBy("a", "b", *names).agg(F.count(F.lit(1)).alias("shared"))


def _enough(pairs: DataFrame, heads: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of groups whose prefixes share enough. Of two sets, all that both hold up to
    the end of one prefix is in both prefixes, and the rest is behind that prefix: an intersection is at most the
    prefixes' intersection and ``ceil(t * size) - 1`` of the larger set."""
    p, q = t.numerator, t.denominator
    one = heads.select(F.col("gid").alias("a"), F.col("n").alias("an"), F.col("toks").alias("ta"))
    two = heads.select(F.col("gid").alias("b"), F.col("n").alias("bn"), F.col("toks").alias("tb"))
    both = pairs.join(one, "a").join(two, "b")
    most = F.size(F.array_intersect("ta", "tb")) + F.expr(f"(greatest(an, bn) * {p} + {q - 1}) div {q}") - 1
    return both.where(most * (p + q) >= (F.col("an") + F.col("bn")) * p).select("a", "b")


def _spread(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node, those without links alone."""
    found = components(links).select("node", F.col("component").alias("comp"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _apart(meet: DataFrame, members: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of shingles whose groups are in more than one component, with the smallest and
    largest component of each group's nodes."""
    of = members.join(comp, "node").groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = meet.join(of, "gid")
    open_ = rows.groupBy("tok").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("tok")
    return write_table(rows.join(open_, "tok"), "apart")


def keep_first(docs: DataFrame, *, similarity: float = SIMILARITY, n: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (nulls last). Rows
    without shingles stay. Of rows repeated with one doc_id and text one stays."""
    rows = _labelled(docs, similarity, n).where(F.col("comp").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid"))
    kept = rows.groupBy("comp").agg(first.alias("f")).select(F.col("f.rid").alias("rid"), F.lit(True).alias("stays"))
    state = (
        rows.join(kept, "rid", "left")
        .groupBy(F.col("doc_id").alias("_jc_id"), F.col("crc").alias("_jc_crc"))
        .agg(F.max(F.coalesce("stays", F.lit(False))).alias("_jc_stays"), F.count(F.lit(1)).alias("_jc_copies"))
        .where(~F.col("_jc_stays") | (F.col("_jc_copies") > 1))
    )
    state = write_table(state, "judged")
    on = F.col("doc_id").eqNullSafe(F.col("_jc_id")) & (_crc() == F.col("_jc_crc"))
    gone = docs.join(state, on, "left_anti")
    if state.where("_jc_stays").isEmpty():
        return gone
    again = docs.join(state.where("_jc_stays"), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return gone.unionByName(again)
