"""Jaccard self-join over word shingles, by set relations.

Documents with equal sets form one class. All sets order shingles alike: those not known to be
frequent by hash, then frequent ones, rarest first. A class posts the first quarter of its order
plus one (linked sets share a posted shingle) with its size and the position. No link is lost: every
step below skips only what a bound on the overlap rules out.

Index lists are in order of size and position. In short lists a probe skips the rest of a list once
sizes are too far apart, and entries whose position leaves too little before and after it; a pair
goes on if the lists in which it meets, with what lies behind both prefixes, can make a link. Such
pairs hang together in families of similar sets.

Long lists are first probed by one set alone, that with the fewest rare shingles; lists inside one
component by then are done. The rest are bundled by their smallest set, cut into blocks by size and position, and two blocks meet
only if their bounds allow a link and they aren't one component.

Families and pairs of blocks are units of bounded size. In a unit an index of its sets gives the
answers of one set by counting; the answers of a set linked to it follow from these: only shingles
that one of the two has and the other lacks are counted again, and nothing at all where even those
can't make a new link. Only a spanning star of a unit's links goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import BROADCAST_IDS, materialize, spare_name, strings, text_batches, tidy, without
from tessera.llm.components import components

#: Shingles counted together when frequent ones are looked for, and the least count that is noted.
COUNTED = 4_000_000
NOTED = 2
#: A shingle noted more often than one of OFTEN sets would be is treated as frequent; at most FREQUENT
#: of them, the most common. Which ones are only moves work about.
OFTEN = 32
FREQUENT = 500_000
#: Lists up to this length give their pairs directly.
SHORT_LIST = 64
#: Sets and shingles of a block of a long list; a unit holds two blocks.
BLOCK_SETS = 1024
BLOCK_ITEMS = 400_000
#: Pairs that are added up before they leave a task.
PAIRS = 300_000
#: Rows of whole texts or sets that pass to a Python worker at once.
ROWS = 500


def _prefix_size(n):
    return n // 4 + 1


def _need(total):
    """Least overlap of linked sets whose sizes make ``total``."""
    return (3 * total + 6) // 7


def _raw(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in strings(part.column(column))]


def _behind(n: str) -> Column:
    """Shingles of a set of size ``n`` that aren't posted."""
    return F.col(n) - F.floor(F.col(n) / 4) - 1


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, broadcast if they are few: what they are joined with is then filtered before any shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), key (128 bits of the sorted set); with n = -1: shingles ``often`` that
    several distinct sets of a task have, and how many (``times``)."""

    def noted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        h, c = h[c >= NOTED].view(np.int64), c[c >= NOTED]
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([h], pa.list_(pa.int64())), pa.array([c], pa.list_(pa.int64()))], names=["doc_id", "n", "key", "often", "times"])

    def run(batches):
        held, size, known = [], 0, set()
        for part in text_batches(batches, rows=ROWS, size=1_000_000):
            sets = shingles.sets(_raw(part, 1))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            none = pa.nulls(len(sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), none, none], names=["doc_id", "n", "key", "often", "times"])
            for k, s in zip(keys, sets, strict=True):
                if k not in known:
                    known.add(k)
                    held.append(s)
                    size += len(s)
            if size >= COUNTED:
                yield noted(held)
                held, size, known = [], 0, set()
        if held:
            yield noted(held)
        tidy()

    return docs.mapInArrow(run, "doc_id long, n long, key binary, often array<long>, times array<long>")


def _frequent(noted: DataFrame) -> np.ndarray:
    """The frequent shingles, rarest first, by what the runs have noted (rows of :func:`_sizes` with n = -1).

    The more runs a shingle's sets are spread over, the fewer of them meet in one and are noted, so the
    bound falls with the number of runs: it is what a shingle of OFTEN sets may expect.
    """
    runs = noted.count()
    bound = OFTEN * -np.expm1(-OFTEN / max(1, runs))
    each = noted.select(F.explode(F.arrays_zip("often", "times")).alias("z")).groupBy(F.col("z.often").alias("h")).agg(F.sum("z.times").alias("c"))
    found = each.where(F.col("c") > float(bound)).orderBy(F.desc("c"), "h").limit(FREQUENT).select("h").toArrow()
    return found.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """One row per posted shingle of ``texts`` (rep, text): h, rep, n, pos, hot (is it frequent).

    ``common`` has the frequent shingles, rarest first.
    """
    rank = np.argsort(common, kind="stable")
    known = common[rank]

    def run(batches):
        for part in text_batches(batches, rows=ROWS, size=1_000_000):
            reps = part.column(0).to_numpy()
            hs, hots, ns = [], [], []
            for s in shingles.sets(_raw(part, 1)):
                k = _prefix_size(len(s))
                hot = np.zeros(len(s), bool)
                if len(known):
                    place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hot = known[place] == s
                cold = s[~hot][:k]
                if len(cold) < k:
                    late = s[hot][np.argsort(rank[place[hot]])][: k - len(cold)]
                    hots.append(np.repeat([False, True], [len(cold), len(late)]))
                    cold = np.concatenate([cold, late])
                else:
                    hots.append(np.zeros(k, bool))
                hs.append(cold)
                ns.append(len(s))
            size = np.array([len(h) for h in hs], np.int64)
            pos = np.concatenate([*(np.arange(k, dtype=np.int32) for k in size), np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*hs, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(reps, size)), pa.array(np.repeat(np.array(ns, np.int32), size)), pa.array(pos), pa.array(np.concatenate([*hots, np.zeros(0, bool)]))],
                names=["h", "rep", "n", "pos", "hot"],
            )

    return texts.mapInArrow(run, "h long, rep long, n int, pos int, hot boolean")


def meetings(h: np.ndarray, rep: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs (a, na, b, nb) of entries of the same list that sizes and positions allow; a is smaller.

    Lists lie end to end, each in order of size: where a size is too large, the rest of the list is
    skipped. What two sets share lies before the meeting in both, after it in both, or is it.
    """
    found = [[], [], [], []]
    i, d = np.arange(len(h)), 1
    while len(i):
        i = i[: np.searchsorted(i, len(h) - d)]
        i = i[h[i] == h[i + d]]
        i = i[100 * n[i] >= 75 * n[i + d]]
        j = i + d
        most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        ok = most >= _need(n[i] + n[j])
        x, y = i[ok], j[ok]
        turn = (n[x] == n[y]) & (rep[x] > rep[y])
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        for out, v in zip(found, (rep[x], n[x], rep[y], n[y]), strict=True):
            out.append(v)
        d += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _lists(postings: DataFrame) -> DataFrame:
    """Read the lists once. With h null: a short list of several sets, in order: reps, ns, poss (sizes
    and positions) and its smallest set (first). Else entries of long lists and of frequent shingles:
    h, rep, n, pos. So there are never more rows than entries."""
    names = ["h", "rep", "n", "pos", "first", "reps", "ns", "poss"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def entries(h, rep, n, pos):
        none = [pa.nulls(len(h), t) for t in (pa.int64(), longs, ints, ints)]
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(rep), pa.array(n), pa.array(pos.astype(np.int32)), *none], names=names)

    def lists(h, rep, n, pos):
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = pa.array(np.append(starts, len(h)).astype(np.int32))
        none = [pa.nulls(len(starts), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rep, n, pos.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*none, pa.array(np.minimum.reduceat(rep, starts)), *columns], names=names)

    def run(batches):
        tail = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        flushed = None  # list of which entries have left already

        def whole(rows, last):
            """Deal with the lists of ``rows``; the last one may go on unless ``last``."""
            nonlocal tail, flushed
            h = rows[0]
            if not len(h):
                return
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            length = np.diff(np.concatenate([starts, [len(h)]]))
            keep = np.repeat(length, length)
            far = (keep > SHORT_LIST) | ((h == flushed) if flushed is not None else False)
            short = ~far & (keep > 1)
            if not last and not far[-1]:
                tail = [x[starts[-1] :] for x in rows]
                short[starts[-1] :] = False
            else:
                tail = [x[:0] for x in rows]
            if far.any():
                yield entries(*(x[far] for x in rows))
            flushed = int(h[-1]) if far[-1] else None
            if short.any():
                yield lists(*(x[short] for x in rows))

        for part in batches:
            rows = [part.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            hot = part.column(4).to_numpy(zero_copy_only=False)
            if hot.any():
                yield entries(*(x[hot] for x in rows))
                rows = [x[~hot] for x in rows]
            yield from whole([np.concatenate([t, x]) for t, x in zip(tail, rows, strict=True)], False)
        rest, tail = tail, [x[:0] for x in tail]
        yield from whole(rest, True)
        tidy()

    # frequent shingles pass through, so their rows may go anywhere
    place = F.when(F.col("hot"), F.xxhash64("rep")).otherwise(F.col("h"))
    dealt = postings.withColumn("place", place).repartition("place").drop("place").sortWithinPartitions("hot", "h", "n", "pos")
    return dealt.select("h", "rep", "n", "pos", "hot").mapInArrow(run, "h long, rep long, n int, pos int, first long, reps array<long>, ns array<int>, poss array<int>")


def _meetings(lists: DataFrame) -> DataFrame:
    """Pairs a, b with sizes na, nb of the short lists (first, reps, ns, poss) and in how many they meet (c).

    Lists with one smallest set come together: similar sets share most of their lists, so what one
    pair has in them is added up here and leaves as few rows, not one a list.
    """

    def added(held):
        a, na, b, nb = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, na, b, nb = a[order], na[order], b[order], nb[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
        count = np.diff(np.concatenate([first, [len(a)]]))
        return pa.RecordBatch.from_arrays([pa.array(a[first], pa.int64()), pa.array(na[first].astype(np.int32)), pa.array(b[first], pa.int64()), pa.array(nb[first].astype(np.int32)), pa.array(count.astype(np.int32))], names=["a", "na", "b", "nb", "c"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            length = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            spent = np.cumsum(length * (length - 1) // 2)
            at = 0
            while at < len(length):
                to = max(at + 1, int(np.searchsorted(spent, (spent[at - 1] if at else 0) + PAIRS, side="right")))
                rep, n, pos = (c.slice(at, to - at).flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
                got = meetings(np.repeat(np.arange(to - at), length[at:to]), rep, n, pos)
                held.append(got)
                size += len(got[0])
                at = to
                if size > PAIRS:
                    yield added(held)
                    held, size = [], 0
        if size:
            yield added(held)
        tidy()

    dealt = lists.repartition("first").sortWithinPartitions("first").select("reps", "ns", "poss")
    return dealt.mapInArrow(run, "a long, na int, b long, nb int, c int")


def _chosen(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Texts of the classes ``reps`` (rep): rep, text."""
    return docs.join(_small(reps), docs["doc_id"] == reps["rep"], "left_semi").select(F.col("doc_id").alias("rep"), "text")


def _full_sets(texts: DataFrame) -> DataFrame:
    """The whole sets of ``texts`` (rep, text), as sorted 64-bit hashes in a binary."""

    def run(batches):
        for part in text_batches(batches, rows=ROWS, size=1_000_000):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingles.sets(_raw(part, 1))], pa.binary())], names=["rep", "items"])

    return materialize(texts.mapInArrow(run, "rep long, items binary"), "jaccard-sets", ROWS)


def _labels(links: list[DataFrame]) -> DataFrame:
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return materialize(components(edges), "jaccard-components")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose shingle sets have a Jaccard likeness of 0.75 or more.

    Returns one row per input row: doc_id, n_shingles (size of its set of distinct five-word
    shingles; fewer words are one shingle) and component_id (the smallest doc_id reachable by
    links). A document without words, or with null text, has an empty set and is alone. Repeated
    rows are linked like copies. Null ids keep their row with a null component. Other columns are
    not carried. An empty table gives an empty one.
    """
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    every = materialize(_sizes(src), "jaccard-base", ROWS)
    base = every.where("n >= 0").select("doc_id", "n", "key")
    named = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    # a row id that repeats with other texts may stand for several classes: it posts them all
    texts = _chosen(src, classes.select("rep").distinct())
    lists = materialize(_lists(_prefixes(texts, _frequent(every.where("n < 0")))), "jaccard-lists")
    rows = lists.where("h IS NOT NULL").select("h", "rep", "n", "pos")
    # of each set: entries in long lists, the posted shingles before the first of them, entries in short lists
    unlisted = materialize(rows.groupBy("rep").agg(F.count(F.lit(1)).alias("u"), F.min("pos").alias("cold")), "jaccard-unlisted")
    short = lists.where("h IS NULL").select(F.explode("reps").alias("rep")).join(_small(unlisted.select("rep")), "rep", "left_semi")
    unlisted = materialize(unlisted.join(short.groupBy("rep").agg(F.count(F.lit(1)).alias("s")), "rep", "left").fillna(0, ["s"]), "jaccard-listed")
    pairs = materialize(_possible(_meetings(lists.where("h IS NULL")), unlisted), "jaccard-pairs")
    involved = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(unlisted.select("rep")).distinct()
    full = _full_sets(_chosen(src, materialize(involved, "jaccard-involved")))
    links = [*_families(pairs, full), _leaders(rows, unlisted, full)]
    labels = _labels(links)
    more = _blocks(rows, full, labels)
    if more is not None:
        labels = _labels([*links, more])

    found = classes.join(labels, classes["rep"] == labels["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = base.join(found, "key", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each linked group: that of the smallest id.

    Documents without words and rows with a null id stay. Of rows that repeat an id one stays.
    """
    found = materialize(jaccard_components(docs, doc_id, text), "jaccard-found")
    kept = without(docs, found.where("component_id <> doc_id").select("doc_id"), doc_id)
    named = found.where("doc_id IS NOT NULL")
    if named.count() != named.select("doc_id").distinct().count():
        row = spare_name("row", kept.columns)
        order = Window.partitionBy(doc_id).orderBy(*[F.col(c) for c in kept.columns if c != doc_id])
        once = kept.where(F.col(doc_id).isNotNull()).withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
        kept = once.unionByName(kept.where(F.col(doc_id).isNull()))
    return kept


def _possible(met: DataFrame, unlisted: DataFrame) -> DataFrame:
    """Pairs (a, b, met, na, nb) whose overlap may suffice.

    What two sets share is in both prefixes, or behind the prefix that ends first. Of the former,
    ``met`` were counted, and others can only be among the entries in long lists.
    """
    pairs = met.groupBy("a", "na", "b", "nb").agg(F.sum("c").alias("met"))
    few = unlisted.count() <= BROADCAST_IDS
    for side in "ab":
        u = unlisted.select(F.col("rep").alias(side), F.col("u").alias("u" + side))
        pairs = pairs.join(F.broadcast(u) if few else u, side, "left")
    need = F.floor((3 * (F.col("na") + F.col("nb")) + 6) / 7)
    unseen = F.coalesce(F.least("ua", "ub", F.coalesce("ua", F.lit(0)), F.coalesce("ub", F.lit(0))), F.lit(0))
    return pairs.where(F.col("met") + unseen + F.greatest(_behind("na"), _behind("nb")) >= need).select("a", "b", "met", "na", "nb")


def _families(pairs: DataFrame, full: DataFrame) -> list[DataFrame]:
    """Links among the candidate pairs.

    Families that fit into one unit are answered there, each set sent once. In larger ones a set is
    first compared with the one it meets most; what is left between components comes after.
    """
    family = materialize(components(pairs.select("a", "b")), "jaccard-families")
    sizes = pairs.select(F.col("a").alias("node"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("node"), F.col("nb").alias("n"))).distinct()
    totals = family.join(sizes, "node").groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    large = materialize(totals.where((F.col("c") > 2 * BLOCK_SETS) | (F.col("t") > 2 * BLOCK_ITEMS)).select("component"), "jaccard-large")
    unit = family.join(large, "component", "left_anti").select(F.col("component").alias("unit"), F.col("node").alias("rep"))
    links = [_unit_links(unit, full, "jaccard-small-links")]
    if large.isEmpty():
        return links
    inside = family.join(large, "component").select(F.col("node").alias("a"))
    pairs = materialize(pairs.join(inside, "a", "left_semi"), "jaccard-large-pairs")
    best = pairs.groupBy("b", "nb").agg(F.max(F.struct("met", "a")).alias("m")).select(F.col("m.a").alias("a"), "b", "nb")
    links.append(_star_links(best, full, "jaccard-best-links"))
    labels = _labels(links)
    la = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    links.append(_star_links(rest, full, "jaccard-rest-links"))
    return links


def _star_links(pairs: DataFrame, full: DataFrame, name: str) -> DataFrame:
    """Links (a, b) among ``pairs`` (a, b, nb), and those found beside them.

    The sets that one set is to be compared with are dealt into units of bounded size that all hold it,
    so only sets of ``pairs`` go out, each as often as it is a ``b``.
    """
    pairs = materialize(pairs.select("a", "b", "nb"), f"{name}-pairs")
    size = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("nb") / BLOCK_ITEMS)).cast("int").alias("k"))
    dealt = pairs.join(size, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("k"))).alias("unit"), "a", "b")
    units = dealt.select("unit", F.col("b").alias("rep")).unionByName(dealt.select("unit", F.col("a").alias("rep")).distinct())
    return _unit_links(units, full, name)


def answers(sets: list[np.ndarray]) -> np.ndarray:
    """Of the sets of one unit, which one each is tied to by links (itself for one of each group).

    A set without a group counts its shingles through the unit's index: its answers. Sets linked to
    it, directly or by others, derive theirs from these by the shingles that differ.
    """
    n = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = count[token] > 1  # others can't add to an overlap
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    entries = owner[order]
    ends = np.cumsum(np.bincount(token, minlength=len(count)))
    own = np.split(token, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])

    def counts(tokens):
        if not len(tokens):
            return np.zeros(len(sets), np.int64)
        lo = np.where(tokens > 0, ends[tokens - 1], 0)
        size = ends[tokens] - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.bincount(entries[at], minlength=len(sets))

    root = np.full(len(sets), -1)
    for first in np.argsort(n, kind="stable")[::-1]:
        if root[first] >= 0:
            continue
        root[first] = first
        base = counts(own[first])
        open_ = np.flatnonzero((root < 0) & (base > 0))
        front = [first]
        while front and len(open_):
            x = front.pop()
            if x == first:
                overlap = base[open_]
            else:
                gained = np.setdiff1d(own[x], own[first], assume_unique=True)
                if not (base[open_] + len(gained) >= _need(n[x] + n[open_])).any():
                    continue
                lost = np.setdiff1d(own[first], own[x], assume_unique=True)
                overlap = (base + counts(gained) - counts(lost))[open_]
            hit = overlap >= _need(n[x] + n[open_])
            new = open_[hit]
            root[new] = first
            front.extend(new.tolist())
            open_ = open_[~hit]
            if x == first and len(new):  # their further shingles may reach sets that the first doesn't meet
                open_ = np.flatnonzero(root < 0)
    return root


def _unit_links(units: DataFrame, full: DataFrame, name: str) -> DataFrame:
    """Links inside each unit (unit, rep) of bounded size, as stars (a, b)."""

    def tied(reps, sets):
        reps = np.array(reps, np.int64)
        root = answers(sets)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(reps[far]), pa.array(reps[root[far]])], names=["a", "b"])

    def run(batches):
        unit, reps, sets = None, [], []
        for part in batches:
            for u, rep, items in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if u != unit:
                    if len(reps) > 1:
                        yield tied(reps, sets)
                    unit, reps, sets = u, [], []
                reps.append(rep)
                sets.append(np.frombuffer(items, np.uint64))
        if len(reps) > 1:
            yield tied(reps, sets)
        tidy()

    units = materialize(units.distinct(), f"{name}-units")
    dealt = full.join(_small(units), "rep").select("unit", "rep", "items").repartition("unit").sortWithinPartitions("unit")
    return materialize(dealt.mapInArrow(run, "a long, b long"), name, ROWS)


def _leaders(rows: DataFrame, unlisted: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) that the leader of each long list has, and those found beside them.

    The leader is the set with the fewest posted shingles outside long lists. Sets of its lists are
    dealt into units of bounded size that all hold the leader, each set once a leader.
    """
    placed = rows.join(unlisted.select("rep", "cold", "s"), "rep")
    leaders = placed.groupBy("h").agg(F.min(F.struct("cold", "n", "rep", "s")).alias("m")).select("h", F.col("m.rep").alias("leader"), F.col("m.n").alias("ln"), F.col("m.s").alias("ls"))
    close = (F.least("n", "ln") * 100 >= F.greatest("n", "ln") * 75) & (F.col("rep") != F.col("leader"))
    met = placed.join(leaders, "h").where(close).groupBy("leader", "rep", "n", "s", "ln", "ls").agg(F.count(F.lit(1)).alias("met"))
    # they can share what met, as much of short lists as the one with less has there, and what isn't posted
    need = F.floor((3 * (F.col("n") + F.col("ln")) + 6) / 7)
    met = met.where(F.col("met") + F.least("s", "ls") + F.greatest(_behind("n"), _behind("ln")) >= need)
    met = materialize(met.select("leader", "rep", "n"), "jaccard-led")
    size = met.groupBy("leader").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ITEMS)).cast("int").alias("k"))
    dealt = met.join(size, "leader").select(F.xxhash64("leader", F.pmod(F.xxhash64("rep"), F.col("k"))).alias("unit"), "leader", "rep")
    units = dealt.select("unit", "rep").unionByName(dealt.select("unit", F.col("leader").alias("rep")).distinct())
    return _unit_links(units, full, "jaccard-leader-links")


def _blocks(rows: DataFrame, full: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Links (a, b) found in long lists that aren't inside one component yet, as stars.

    Lists of the same sets are bundled first. One is cut into blocks of bounded rows and shingles; where it takes several, by size class,
    position class and, for components with many rows, component. Two blocks meet only if the sizes
    in them allow a link, if enough shingles lie behind the positions in them (where linked sets
    meet first, all they share lies there), and if they aren't of one component.
    """
    known = labels.select(F.col("node").alias("rep"), "component")
    placed = rows.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lists = placed.groupBy("h").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.min("rep").alias("first")).where("_lo <> _hi")
    placed = materialize(placed.join(lists.select("h", "first"), "h"), "jaccard-open")
    if placed.isEmpty():
        return None
    placed = materialize(_bundled(placed), "jaccard-bundles")
    size = placed.groupBy("h").agg(((F.count(F.lit(1)) > BLOCK_SETS) | (F.sum("n") > BLOCK_ITEMS)).alias("many"))
    placed = placed.join(size, "h")
    # sizes of one class differ by less than 4/3; positions are classed by 28ths of the size
    size_class = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int") * 8 + F.floor(28 * F.col("pos") / F.col("n")).cast("int")
    shares = placed.groupBy("h", "component").agg((F.count(F.lit(1)) > BLOCK_SETS // 4).alias("own")).where("own")
    placed = placed.join(shares, ["h", "component"], "left")
    placed = placed.select("h", "rep", "n", "pos", F.when(F.col("many"), size_class).otherwise(0).alias("s"), F.when(F.col("many") & F.col("own"), F.col("component")).alias("of"))
    groups = placed.groupBy("h", "s", "of").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ITEMS)).cast("int").alias("k"))
    same = lambda a, b: (a["h"] == b["h"]) & (a["s"] == b["s"]) & a["of"].eqNullSafe(b["of"])
    p, g = placed.alias("p"), groups.alias("g")
    dealt = p.join(g, same(_of("p"), _of("g"))).select("p.*", F.xxhash64("p.h", "p.s", F.coalesce("p.of", F.lit(0)), F.col("p.of").isNull(), F.pmod(F.xxhash64("p.rep"), F.col("g.k"))).alias("block"))
    dealt = materialize(dealt, "jaccard-long")
    x = dealt.groupBy("h", "block", "of").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    y = x.select("h", *[F.col(c).alias(c + "2") for c in ("block", "of", "lo", "hi", "rest")])
    need = F.floor((3 * (F.col("lo") + F.col("lo2")) + 6) / 7)
    fit = (F.col("hi") * 100 >= F.col("lo2") * 75) & (F.col("hi2") * 100 >= F.col("lo") * 75) & (F.least("rest", "rest2") >= need)
    units = x.join(y, "h").where((F.col("block") <= F.col("block2")) & fit & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False)))
    units = materialize(units.select("block", "block2", F.xxhash64("block", "block2").alias("unit")), "jaccard-units")
    both = units.select("unit", "block").unionByName(units.where("block <> block2").select("unit", F.col("block2").alias("block")))
    return _unit_links(dealt.select("block", "rep").join(both, "block").select("unit", "rep"), full, "jaccard-long-links")


def _bundled(placed: DataFrame) -> DataFrame:
    """Open lists (h, first, rep, n, pos, component), those of one smallest set taken for one list.

    A passage has as many lists as shingles, all of nearly the same sets: each set then goes out once,
    not once a list. A set stands at its first position. Lists stay apart where one would make more pairs of blocks.
    """
    cost = lambda k: k * (k + 1)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ITEMS))
    apart = placed.groupBy("first", "h").agg(blocks.alias("k")).groupBy("first").agg(F.sum(cost(F.col("k"))).alias("apart"))
    once = placed.groupBy("first", "rep", "n").agg(F.lit(1)).groupBy("first").agg(blocks.alias("k"))
    choice = apart.join(once, "first").select("first", (cost(F.col("k")) <= F.col("apart")).alias("one"))
    keys = placed.select("h", "first").distinct().join(choice, "first").select(F.col("h").alias("list"), F.when(F.col("one"), F.col("first")).otherwise(F.col("h")).alias("key"))
    keys = _small(materialize(keys, "jaccard-keys"))  # rows meet them by list, as one smallest set may have many rows
    return placed.join(keys, placed["h"] == keys["list"]).groupBy(F.col("key").alias("h"), "rep", "n", "component").agg(F.min("pos").alias("pos"))


def _of(alias: str) -> dict:
    return {c: F.col(f"{alias}.{c}") for c in ("h", "s", "of")}
