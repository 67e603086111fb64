"""N-gram Jaccard self-join with set-relation skipping, exact for any input.

1. Each text becomes its set of word shingles; texts with one set collapse into it.
2. Shingles are counted over all sets. Only shingles of two sets or more can be
   shared, and they are ordered rarest first, so that most sets have nothing but
   shingles of their own in the prefix that a partner would have to meet.
3. The inverted lists of the remaining prefixes are blocks of sets with equal size
   and position; size and position skip a block as a whole.
4. Rounds of stars join sets with a few pivots of each list. Then a last sweep takes
   the pairs that are still in different components, derives the answers of sets from
   their overlaps with common pivots where these decide, and compares the others.

Pairs whose sets are connected already are never formed, which keeps a large group of
near copies linear; no link between components is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.components import components
from voxloom.llm.scratch import partitions_for, stash
from voxloom.llm.textcols import mix64, shingle_sets, utf8

#: Texts are cut into sets in slices of so many bytes; a flush holds about so many shingles.
SLICE_BYTES = 2 << 20
FLUSH_SHINGLES = 1 << 20
#: Shingles in a bucket of the count, on average; there are as many buckets as that takes.
BUCKET_SHINGLES = 1 << 20
#: Bytes of a shingle in the shuffle, with its share of its set's row.
SHUFFLED_BYTES = 16
#: Shingles that one set in so many has are known to all tasks; there are at most so many times the mean set size of them.
HEAVY_SHARE = 1024
#: Rounds of stars, and the pivots of a list in each.
PIVOT_ROUNDS = 4
PIVOTS = 4


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about SLICE_BYTES of text."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def _digests(values: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; 0 for an empty one."""
    sizes = np.diff(offsets)
    full = sizes > 0
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        sums = np.zeros(len(sizes), np.uint64)
        if full.any():
            sums[full] = np.add.reduceat(mix64(values ^ mix64(np.array([salt], np.uint64))), offsets[:-1][full])
        out.append((mix64(sums + sizes.astype(np.uint64)) * full).view(np.int64))
    return out[0], out[1]


def _binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary rows: the bytes of x[cuts[i] : cuts[i + 1]]."""
    offsets = cuts.astype(np.int64) * x.itemsize
    data = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]).cast(pa.binary())


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, seed: int = 0) -> DataFrame:
    """Rows of two kinds: id, n, sid, other (a text's set size and its two digests; null
    for an empty set) and key, seen (a shingle that many sets of one flush have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sets, known = [], 0, 0, set()

        def frequent() -> pa.RecordBatch:
            keys, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= max(3, sets / (2 * HEAVY_SHARE))
            keys, seen = keys[often], seen[often]
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keys.view(np.int64)), pa.array(seen.astype(np.int64))], names)

        names = ["id", "n", "sid", "other", "key", "seen"]
        for part in _slices(batches, 1):
            values, offsets = shingle_sets(part.column(1), words)
            sid, other = _digests(values, offsets, seed)
            empty = np.diff(offsets) == 0
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(sid, mask=empty), pa.array(other, mask=empty), none, none], names)
            new = []
            for i, s in enumerate(sid.tolist()):
                if not empty[i] and s not in known:
                    known.add(s)
                    new.append(i)
            held += [values[offsets[i] : offsets[i + 1]] for i in new]
            size += sum(int(offsets[i + 1] - offsets[i]) for i in new)
            sets += len(new)
            if size >= FLUSH_SHINGLES:
                yield frequent()
                held, size, sets = [], 0, 0
        if held:
            yield frequent()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, sid long, other long, key long, seen long")


def _shared_shingles(df: DataFrame, text_col: str, words: int, seed: int, buckets: int, total: int, heavy_keys: np.ndarray, heavy_seen: np.ndarray) -> DataFrame:
    """sid, n, first, keys: per set that can have a partner its shared shingles, rarest first; ``first`` is their first
    position. ``total`` shingles are shuffled, in tasks of bounded size however many these are."""
    bits = buckets.bit_length() - 1
    rest = -(-(64 - bits) // 8)
    shared = df.sparkSession.sparkContext.broadcast((heavy_keys, heavy_seen))
    u64, names = np.uint64, ["bucket", "heavy", "sids", "runs", "keys", "seen", "owners", "sizes"]
    schema = "bucket int, heavy boolean, sids binary, runs binary, keys binary, seen binary, owners binary, sizes binary"

    def packed(bucket: np.ndarray, heavy: bool, sid: np.ndarray, key: np.ndarray, seen: np.ndarray | None) -> pa.RecordBatch:
        """One row per bucket: its sets as runs of up to 255 keys, and the keys. Entries come sorted by bucket, then set."""
        new = np.ones(len(sid), bool)
        new[1:] = (sid[1:] != sid[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.arange(len(sid))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % 255 == 0
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(sid))).astype(np.uint8)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        cuts = np.append(first, len(bucket))
        run_cuts = np.searchsorted(heads, cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[first].astype(np.int32)),
                pa.array([heavy] * len(first), pa.bool_()),
                _binary(sid[heads], run_cuts),
                _binary(runs, run_cuts),
                _binary(key, cuts),
                _binary(seen.astype(np.uint32), cuts) if seen is not None else pa.nulls(len(first), pa.binary()),
                *[pa.nulls(len(first), pa.binary())] * 2,
            ],
            names,
        )

    def sized(sid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Sets and their sizes, one row per bucket of sets."""
        home = (mix64(sid.view(u64)) & u64(buckets - 1)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        home, sid, n = home[order], sid[order], n[order]
        first = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        cuts, none = np.append(first, len(home)), pa.nulls(len(first), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(home[first]), pa.array([True] * len(first)), none, none, none, none, _binary(sid, cuts), _binary(n.astype(np.uint32), cuts)], names)

    def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    def opened(table: pa.Table) -> tuple[np.ndarray, ...]:
        """(set, key bytes, count) of all entries."""
        return np.repeat(joined(table, "sids", np.int64), joined(table, "runs", np.uint8)), joined(table, "keys", np.uint8), joined(table, "seen", np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = set(), [], 0
        often, often_seen = shared.value

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([x[2] for x in held])
            sizes = np.array([len(x[2]) for x in held])
            own = np.array([x[0] for x in held], np.int64)
            yield sized(own, np.array([x[1] for x in held]))
            sid = np.repeat(own, sizes)
            at = np.minimum(np.searchsorted(often, key), max(0, len(often) - 1))
            is_heavy = often[at] == key if len(often) else np.zeros(len(key), bool)
            if is_heavy.any():
                home = (mix64(sid[is_heavy].view(u64)) & u64(buckets - 1)).astype(np.int32)
                order = np.argsort(home, kind="stable")
                pick = np.flatnonzero(is_heavy)[order]
                yield packed(home[order], True, sid[pick], key[pick], often_seen[at[pick]])
            pick = np.flatnonzero(~is_heavy)
            bucket = (key[pick] >> u64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            pick = pick[order]
            # the bucket gives the first bits; the bytes of the others follow
            low = (key[pick] << u64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :rest]
            yield packed(bucket[order], False, sid[pick], np.ascontiguousarray(low).view(f"V{rest}").ravel(), None)

        for part in _slices(batches, 0):
            values, offsets = shingle_sets(part.column(0), words)
            sid, _ = _digests(values, offsets, seed)
            for i, s in enumerate(sid.tolist()):
                n = int(offsets[i + 1] - offsets[i])
                if n and s not in known:
                    known.add(s)
                    held.append((s, n, values[offsets[i] : offsets[i + 1]]))
                    size += n
            if size >= FLUSH_SHINGLES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        """Of one bucket of shingles, those of two sets or more, sent to the buckets of their sets."""
        sid, raw, _ = opened(table)
        bucket = u64(table.column("bucket")[0].as_py())
        wide = np.zeros((len(sid), 8), np.uint8)
        wide[:, :rest] = raw.reshape(-1, rest)
        key = (wide.view(">u8").ravel().astype(u64) >> u64(bits)) | (bucket << u64(64 - bits))
        order = np.argsort(key)
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = key[order[1:]] == key[order[:-1]]
        order = order[same[1:] | same[:-1]]
        order = order[np.lexsort((sid[order], key[order]))]
        sid, key = sid[order], key[order]
        new = np.ones(len(key), bool)  # copies of a set come from several tasks
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        sid, key = sid[new], key[new]
        _, which, seen = np.unique(key, return_inverse=True, return_counts=True)
        seen = seen[which]
        two = seen > 1
        sid, key, seen = sid[two], key[two], seen[two]
        home = (mix64(sid.view(u64)) & u64(buckets - 1)).astype(np.int32)
        order = np.lexsort((sid, home))
        return pa.Table.from_batches([packed(home[order], True, sid[order], key[order], seen[order])])

    def gather(table: pa.Table) -> pa.Table:
        """Of one bucket of sets, those whose prefix reaches a shared shingle."""
        sid, key, seen = opened(table)
        key = key.view(u64)
        order = np.lexsort((key, seen, sid))
        sid, key = sid[order], key[order]
        new = np.ones(len(sid), bool)
        new[1:] = (sid[1:] != sid[:-1]) | (key[1:] != key[:-1])
        sid, key = sid[new], key[new]
        heads = np.flatnonzero(np.append(True, sid[1:] != sid[:-1])) if len(sid) else np.zeros(0, np.int64)
        cuts = np.append(heads, len(sid))
        owners, at = np.unique(joined(table, "owners", np.int64), return_index=True)
        sid = sid[heads]
        n = joined(table, "sizes", np.uint32)[at][np.searchsorted(owners, sid)].astype(np.int64)
        first = n - np.diff(cuts)
        able = first < prefix_length(n)
        rows = _binary(key, cuts).filter(pa.array(able))
        return pa.table([pa.array(sid[able]), pa.array(n[able]), pa.array(first[able]), rows], ["sid", "n", "first", "keys"])

    sent = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        return table if key[1].as_py() else count(table)

    parts = partitions_for(df.sparkSession, total * SHUFFLED_BYTES)
    sent = sent.repartition(parts, "bucket", "heavy").groupBy("bucket", "heavy").applyInArrow(counted, schema)
    return sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(gather, "sid long, n long, first long, keys binary")


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Positions that a partner has to meet: with 100 * common >= 80 * union, common >= 0.8 n."""
    return n - (80 * n + 99) // 100 + 1


def _may_link(n1: Column, r1: Column, n2: Column, r2: Column) -> Column:
    """Size and position: whether sets that first meet at these positions can still reach the overlap that a link needs."""
    most = F.lit(1) + F.least(n1 - r1 - 1, n2 - r2 - 1)
    return (100 * F.least(n1, n2) >= 80 * F.greatest(n1, n2)) & (180 * most >= 80 * (n1 + n2))


@F.arrow_udf(T.LongType())
def _overlap(x: pa.Array, y: pa.Array) -> pa.Array:
    out = np.zeros(len(x), np.int64)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        both = np.concatenate([np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)])
        both.sort()
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return pa.array(out)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, common: exact overlaps of pairs of sets."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "na", "nb", _overlap("ka", "kb").alias("common"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


_LINKED = "180 * common >= 80 * (na + nb)"


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root of the components after more links (a, b): the earlier components count as stars."""
    if roots is not None:
        links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(links, "a", "b")


def _links(postings: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node, root of all linked sets; None without any link."""
    known: DataFrame | None = None
    roots: DataFrame | None = None
    lists = postings.withColumns({"root": F.col("sid"), "hub": F.lit(0.0)})
    for turn in range(PIVOT_ROUNDS):
        # pivots are sets that were similar to those they have met, the best one of each class of a hash
        draw = F.xxhash64("sid", F.lit(turn))
        pick = [F.max(F.struct(F.when(F.pmod(draw, F.lit(PIVOTS)) == i, F.col("hub")).alias("c"), draw.alias("h"), "sid", "n", "rank", "root")).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = lists.groupBy("key").agg(*pick, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
        pivots = pivots.select("key", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"))
        pivots = pivots.select("key", F.col("p.sid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.rank").alias("prank"), F.col("p.root").alias("proot"))
        met = lists.join(pivots, "key").where((F.col("root") != F.col("proot")) & _may_link(F.col("n"), F.col("rank"), F.col("pn"), F.col("prank")))
        pairs = met.select(*_pair("sid", "pivot")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        done = stash(_compared(pairs, sets), "compared")
        known = done if known is None else known.union(done)
        found = done.where(_LINKED).select("a", "b")
        if found.isEmpty():
            break
        roots = _joined(roots, found)
        similar = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
        hubs = known.select(F.explode(F.array("a", "b")).alias("s"), similar.alias("j")).groupBy("s").agg(F.avg("j").alias("hub"))
        lists = postings.join(roots, F.col("sid") == F.col("node"), "left").join(hubs, F.col("sid") == F.col("s"), "left")
        lists = stash(lists.select("key", "sid", "n", "rank", F.coalesce("root", "sid").alias("root"), F.coalesce("hub", F.lit(0.0)).alias("hub")), "lists")
    # the last sweep: per list, what isn't in its most frequent component meets all of the list
    salts = max(1, postings.count() // 100_000)
    salt = F.pmod(F.xxhash64("sid"), F.lit(salts)).alias("salt")
    blocks = lists.groupBy("key", "n", "rank", "root", salt).agg(F.collect_list("sid").alias("sids"))
    by_root = lists.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    major = by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = blocks.join(major.select("key", F.col("top.root").alias("major")), "key")
    mixed = stash(mixed, "blocks")
    minor = mixed.where("root != major").select("key", *[F.col(c).alias("m_" + c) for c in ("n", "rank", "root", "sids")])
    met = mixed.join(minor, "key").where((F.col("root") != F.col("m_root")) & _may_link(F.col("n"), F.col("rank"), F.col("m_n"), F.col("m_rank")))
    met = met.select(F.explode("sids").alias("x"), "m_sids").select("x", F.explode("m_sids").alias("y"))
    pairs = met.select(*_pair("x", "y")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    sizes = sets.select("sid", "n")
    pairs = pairs.join(sizes.select(F.col("sid").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b")
    pairs = stash(pairs, "pairs")
    derived = stash(derive(pairs, known), "derived")
    rest = _compared(derived.where("linked is null"), sets)
    rest = stash(rest.where(_LINKED).select("a", "b"), "last-links")
    sure = derived.where("linked").select("a", "b")
    if sure.isEmpty() and rest.isEmpty():
        return roots
    return _joined(roots, sure.union(rest))


def derive(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with ``linked`` where known overlaps decide it, else null.

    The home of a set is the pivot most similar to it. For the home z of a, with known
    overlaps x of a and y of b, the overlap of a and b is at least x + y - |z| and at most
    min(x, y) + min(|a| - x, |b| - y), and likewise for the home of b: the answers of a set
    follow from those of a very similar one. Each step keeps one row a pair."""
    both = known.select(F.col("a").alias("s"), F.col("na").alias("ns"), F.col("b").alias("z"), F.col("nb").alias("nz"), "common")
    both = both.union(known.select(F.col("b").alias("s"), F.col("nb").alias("ns"), F.col("a").alias("z"), F.col("na").alias("nz"), "common"))
    similar = F.col("common") / (F.col("ns") + F.col("nz") - F.col("common"))
    homes = both.groupBy("s").agg(F.max(F.struct(similar.alias("j"), "z", "nz", "common")).alias("h"))
    met = pairs
    for me, other in (("a", "b"), ("b", "a")):
        home = homes.select(F.col("s").alias(me), F.col("h.z").alias(f"z_{me}"), F.col("h.nz").alias(f"nz_{me}"), F.col("h.common").alias(f"x_{me}"))
        beside = both.select(F.col("s").alias(other), F.col("z").alias(f"z_{me}"), F.col("common").alias(f"y_{me}"))
        met = met.join(home, me, "left").join(beside, [other, f"z_{me}"], "left")
    least = [F.col(f"x_{me}") + F.col(f"y_{me}") - F.col(f"nz_{me}") for me in "ab"]
    most = [F.least(F.when(F.col(f"y_{me}").isNotNull(), F.col(f"x_{me}")), f"y_{me}") + F.least(F.col(f"n{me}") - F.col(f"x_{me}"), F.col(f"n{other}") - F.col(f"y_{me}")) for me, other in ("ab", "ba")]
    need = 80 * (F.col("na") + F.col("nb"))
    sure, never = F.lit(False), F.lit(False)
    for low, high in zip(least, most, strict=True):
        sure, never = sure | F.coalesce(180 * low >= need, F.lit(False)), never | F.coalesce(180 * high < need, F.lit(False))
    return met.select("a", "b", "na", "nb", F.when(sure, True).when(never, False).alias("linked"))


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """Links texts whose sets of distinct ``words``-word shingles have a Jaccard similarity of
    0.8 or more (100 * common >= 80 * union), A-Z lowered, words between ASCII white space.

    Returns per row: ``id_col``, n_shingles and component_id, the smallest id reachable by
    links. A text with fewer words has one shingle of them all. A null or empty text has
    none, links with nothing and is its own component. Equal sets link, so copies share a
    component, as do rows repeated with one id; rows with a null id take part and can end
    in a component of another's id, or of null. Only the two columns named are read.

    Sets are told apart by 64-bit digests, checked against a second digest; if two sets
    ever share the first, all digests are drawn anew. Shingles are told apart by 64-bit hashes:
    of n different ones, about n * n / 2 ** 65 pairs share one by chance (10 ** 10 shingles: 3),
    and such a pair adds one to an overlap of two sets that hold its two."""
    for seed in range(8):
        found = stash(signatures(df, id_col, text_col, words, seed), "signatures")
        texts = found.where("n is not null").select("id", "n", "sid", "other")
        every = texts.where("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        every = stash(every, "sets")
        total = every.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("n"), F.max(F.col("lo") != F.col("hi")).alias("clash")).first()
        if not total["clash"]:
            break
    else:
        raise RuntimeError("digests of different sets keep colliding")
    linked = None
    if total["sets"]:
        heavy = found.where("key is not null").groupBy("key").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(3.0, total["sets"] / (2 * HEAVY_SHARE)))
        # at most 2 * HEAVY_SHARE times the mean set size: a few MB at any number of sets
        heavy = heavy.toArrow().sort_by("key")
        keys, seen = heavy["key"].to_numpy().view(np.uint64), heavy["seen"].to_numpy()
        order = np.argsort(keys)
        buckets = 1 << min(30, max(8, int(total["n"] // BUCKET_SHINGLES).bit_length()))
        sets = stash(_shared_shingles(df, text_col, words, seed, buckets, total["n"], keys[order], np.minimum(seen[order], 2**32 - 1).astype(np.uint32)), "shared")

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sid, n, first = (batch.column(i).to_numpy() for i in range(3))
                take = prefix_length(n) - first
                heads = [np.frombuffer(x.as_buffer(), np.int64)[:k] for x, k in zip(batch.column(3), take.tolist(), strict=True)]
                take = np.array([len(x) for x in heads], np.int64)
                rank = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(first, take)
                key = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(sid, take)), pa.array(np.repeat(n, take)), pa.array(rank)], ["key", "sid", "n", "rank"])

        postings = stash(sets.mapInArrow(prefixes, "key long, sid long, n long, rank long"), "postings")
        linked = None if postings.isEmpty() else _links(postings, sets)
    reps = every.select(F.col("sid").alias("s"), "rep")
    if linked is not None:
        grouped = reps.join(linked, F.col("s") == F.col("node"))
        least = grouped.groupBy("root").agg(F.min("rep").alias("low"))
        low = grouped.join(least, "root").select(F.col("node"), "low")
        # written, so that both sides of the last join come from shuffles and a hot set can be split
        reps = stash(reps.join(low, F.col("s") == F.col("node"), "left").select("s", F.coalesce("low", "rep").alias("rep")), "components")
    return texts.join(reps, F.col("sid") == F.col("s"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("rep")).alias("component_id")
    )
