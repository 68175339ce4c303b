"""MinHash near-duplicates: an LSH forest finds the candidates, full shingle sets decide.

Texts with equal shingle sets are joined to one representative first. Each representative's MinHash signature is sorted
in TREES orders. Where signatures agree in an order's first DEPTH values they form a region; further values order the
region, so that the neighbours of a place are those of longest common prefix with it. Runs of RUN documents have a head; a region of
more is crowded, and also cut where its members' next values differ, one value deeper at a time, until its pieces are that small. Of
each document the neighbour, the head of a run and the head of a piece with which its common prefixes are longest over all
orders are confirmed on the full sets. Most of a large group is one component after that.

What neighbours leave is searched exactly: in every region that still holds documents of two components, all pairs
across components are compared, first by sketches that never overstate how far two sets differ, then on full sets. No
partner or candidate is capped; a pair is left uncompared only where both documents are in one component already. A pair
at the threshold shares no region with a chance of (1 - 0.8^DEPTH)^TREES, about 1 in 8 million, and less above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, own_columns, read_table, scratch, texts, without
from .components import connected_components

TREES = 40
DEPTH = 5
#: Values after the first DEPTH that order a region.
FURTHER = 4
#: Members of a piece of a region that one of them heads.
RUN = 256
PERCENT = 80
#: Rows of a region that meet in one task, and members of their sets (8 bytes each): twice as many, of two blocks.
BLOCK_ROWS = 2048
BLOCK_MEMBERS = 4_000_000
#: Groups up to this many rows are compared offset by offset, others row by row.
SMALL = 64
#: 64-bit words of sketches that are compared at a time.
WORDS = 2_000_000
#: Documents of a block when pairs are confirmed, about.
BLOCK = 256
#: Rows of an order in a range partition, about (15 MB).
RANGE_ROWS = 500_000
#: doc_ids that may be broadcast (8 bytes each, some 40 as a hash relation); beyond, Spark joins by shuffle.
BROADCAST_IDS = 500_000

_VALUES = TREES * DEPTH
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 2**31, _VALUES, "u4") * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, _VALUES, "u4")
_ORDERS = (np.arange(TREES)[:, None] * DEPTH + np.arange(DEPTH + FURTHER)) % _VALUES
_LEFT, _RIGHT, _ALONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct two-word shingles. bytes.lower and bytes.split know ASCII alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))
    if len(h) < 2:
        return h * _ALONE + _LEFT
    x = h[:-1] * _LEFT + (h[1:] ^ (h[1:] >> np.uint64(29))) * _RIGHT
    return np.unique(x ^ (x >> np.uint64(32)))


def orders(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each order, a set's region and its place in it: hash of the first DEPTH signature values, and the next FURTHER."""
    low, x = np.full(_VALUES, 2**32 - 1, "u4"), (found >> np.uint64(32)).astype("u4")
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * _A + _B).min(0), out=low)
    values = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("u8")[_ORDERS]
    region = np.arange(1, TREES + 1).astype("u8") * _ALONE
    for d in range(DEPTH):
        region = (region ^ values[:, d]) * _LEFT
        region ^= region >> np.uint64(29)
    place = np.zeros(TREES, "u8")
    for d in range(DEPTH, DEPTH + FURTHER):
        place = place << np.uint64(16) | values[:, d]
    return region.view("i8"), place.view("i8")


def sketch(found: np.ndarray) -> bytes:
    """Parities of how many members fall on each of 4 to 8 bits a member: two sets differ in at least as many members as
    sketches in bits. Of two lengths, the longer is folded to the shorter."""
    bits = 64 << max(0, (len(found) - 1) // 16).bit_length()
    return np.packbits((np.bincount((found >> np.uint64(11)).astype("i8") & (bits - 1), minlength=bits) & 1).astype("u1")).tobytes()


def describe():
    """Of each text: the size of its set, a 128-bit hash of it, its region and place in each order, its sketch."""

    @F.pandas_udf("n long, s1 long, s2 long, region array<bigint>, place array<bigint>, bits binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                found = shingles(text)
                if len(found):
                    out.append((len(found), *np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8").tolist(), *orders(found), sketch(found)))
                else:
                    out.append((0, None, None, None, None, None))
            n, s1, s2, region, place, bits = zip(*out, strict=True) if out else [()] * 6
            yield pd.DataFrame({"n": np.array(n, "i8"), "s1": pd.array(s1, "Int64"), "s2": pd.array(s2, "Int64"), "region": pd.Series(region, dtype=object), "place": pd.Series(place, dtype=object), "bits": pd.Series(bits, dtype=object)})

    return run


def _able(n, m):
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def common_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the FURTHER values, from the first on, two places in a region have in common."""
    differ = (x ^ y).view("u8")
    return sum((differ < np.uint64(1 << (16 * k))).astype("i8") for k in range(FURTHER))


def pieces(joined: np.ndarray, common: np.ndarray, run: int = RUN) -> np.ndarray:
    """The first row of each row's piece. ``joined``: whether a row has the region of the one before; ``common``: the values that
    both have in common after the first DEPTH. Pieces of more than ``run`` rows are cut where fewer than 1, 2, ... values are in
    common, and in the end, where all are, every ``run`` rows."""
    at, new = np.arange(len(joined)), ~joined
    for depth in range(1, FURTHER + 1):
        begun = np.maximum.accumulate(np.where(new, at, 0))
        size = np.bincount(begun, minlength=len(joined))[begun]
        if not len(size) or size.max() <= run:
            break
        new |= (size > run) & (common < depth)
    begun = np.maximum.accumulate(np.where(new, at, 0))
    return begun + (at - begun) // run * run


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows in order: pairs (a, b) of neighbours (kind 1), of rows with the head of their run of RUN rows (kind 2) and, where a region
    is crowded, with their piece's head (kind 3), all in one region and with the values of their signatures that they have in common
    from the first on (depth), and the rows (a) that share a region (kind 0; also the first and last row, whose neighbours another
    task may have)."""
    last = None  # the row before, not yet out: region, place, doc, n, whether it joins its predecessor
    first, seen, start, head = True, 0, 0, (0, 0, 0)
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch[c].to_numpy("i8") for c in ("region", "place", "doc", "n")]
        old = 0 if last is None else 1
        region, place, doc, n = rows if last is None else (np.r_[x, y] for x, y in zip(last, rows, strict=False))
        joined = np.r_[bool(old and last[4]), region[1:] == region[:-1]]
        at = np.arange(len(doc)) + seen - old
        begun = np.where(joined, -1, at)
        begun[0] = start if old else at[0]
        begun = np.maximum.accumulate(begun)
        lead = begun + (at - begun) // RUN * RUN
        here = np.maximum(lead - at[0], 0)
        head_place, head_doc, head_n = (np.where(lead < at[0], x, y[here]) for x, y in zip(head, (place, doc, n), strict=True))
        inside = np.r_[False, joined[1:]]  # pieces are of a batch, with the row before it
        common = np.r_[0, common_values(place[1:], place[:-1])]
        piece = pieces(inside, common)
        i = 1 + np.flatnonzero(inside[1:])
        i = i[_able(n[i], n[i - 1])]
        j = old + np.flatnonzero((at - lead > 1)[old:])
        j = j[_able(n[j], head_n[j])]
        p = old + np.flatnonzero(((np.arange(len(doc)) - piece > 1) & (piece + at[0] != lead))[old:])
        p = p[_able(n[p], n[piece[p]])]
        out = joined[:-1] | joined[1:]
        if first and len(out):
            out[0], first = True, False
        k = np.flatnonzero(out)
        one = [doc[i], doc[j], doc[p]]
        two = [doc[i - 1], head_doc[j], doc[piece[p]]]
        none = np.zeros(len(i) + len(j) + len(p), "i8")
        yield pd.DataFrame({
            "kind": np.repeat(np.arange(4, dtype="i4"), [len(k), len(i), len(j), len(p)]), "region": np.r_[region[k], none],
            "a": np.r_[doc[k], np.maximum(np.concatenate(one), np.concatenate(two))], "b": np.r_[np.zeros(len(k), "i8"), np.minimum(np.concatenate(one), np.concatenate(two))],
            "depth": np.r_[np.zeros(len(k), "i8"), DEPTH + np.concatenate([common[i], common_values(place[j], head_place[j]), common_values(place[p], place[piece[p]])])],
        })
        seen += len(batch)
        start, head = int(begun[-1]), (int(head_place[-1]), int(head_doc[-1]), int(head_n[-1]))
        last = (region[-1:], place[-1:], doc[-1:], n[-1:], bool(joined[-1]))
    if last is not None:
        yield pd.DataFrame({"kind": np.zeros(1, "i4"), "region": last[0], "a": last[2], "b": np.zeros(1, "i8"), "depth": np.zeros(1, "i8")})


class _Sketches:
    """Sketches of many sets, by length, so that pairs of rows are compared in bulk."""

    def __init__(self, raw: list[bytes]) -> None:
        self.words = np.array([len(x) // 8 for x in raw], "i8")
        self.place, parts = {}, {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            rows = np.frombuffer(b"".join(raw[i] for i in own.tolist()), "u8").reshape(-1, w)
            parts.setdefault(w, []).append((own, rows))
            if w > 1:
                parts.setdefault(w // 2, []).append((own, rows[:, : w // 2] ^ rows[:, w // 2 :]))
        self.rows = {w: np.concatenate([r for _, r in p]) for w, p in parts.items()}
        for w, p in parts.items():
            self.place[w] = np.zeros(len(raw), "i8")
            self.place[w][np.concatenate([o for o, _ in p])] = np.arange(len(self.rows[w]))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least how many members pairs of rows, of sizes that allow for a similarity of PERCENT, differ in."""
        out, level = np.zeros(len(i), "i8"), np.minimum(self.words[i], self.words[j])
        for w in np.unique(level).tolist():
            of, place, rows = np.flatnonzero(level == w), self.place[w], self.rows[w]
            for cut in range(0, len(of), step := max(1, WORDS // w)):
                k = of[cut : cut + step]
                out[k] = np.bitwise_count(rows[place[i[k]]] ^ rows[place[j[k]]]).sum(1, dtype="i8")
        return out


def _maybe(sketches: _Sketches, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows, of fitting sizes, may have a similarity of PERCENT."""
    return (100 + PERCENT) * sketches.differ(i, j) <= (100 - PERCENT) * (n[i] + n[j])


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            count = len(batch)
            sketches, n = _Sketches([*batch["bits_a"], *batch["bits_b"]]), np.r_[batch["n_a"].to_numpy("i8"), batch["n_b"].to_numpy("i8")]
            yield batch.loc[_maybe(sketches, n, np.arange(count), np.arange(count) + count), ["a", "b"]]


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow for a similarity of PERCENT."""
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    return materialise(pairs.mapInPandas(_likely, "a long, b long"))


def _pairs(key: np.ndarray, root: np.ndarray, side: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key whose roots and sides (-1: a component's bulk, which comes last in its key) allow for
    comparison and whose sizes for a similarity of PERCENT."""

    def able(i, j):
        i, j = np.broadcast_arrays(i, j)
        fits = (root[i] != root[j]) & ((key[i] % 2 == 0) | (side[i] != side[j])) & _able(n[i], n[j])
        return i[fits], j[fits]

    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    rows = np.flatnonzero(np.repeat(size <= SMALL, size))
    stop, step = np.repeat(first + size, size), 1
    while len(rows := rows[rows + step < stop[rows]]):
        yield able(rows, rows + step)
        step += 1
    for g in np.flatnonzero(size > SMALL).tolist():
        end = int(first[g] + size[g])
        for at in range(int(first[g]), end):
            if side[at] >= 0:
                yield able(np.array([at]), np.arange(at + 1, end))


def _bulk(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    i, j, count = [], [], 0
    for x, y in found:
        i.append(x)
        j.append(y)
        count += len(x)
        if count >= most:
            yield np.concatenate(i), np.concatenate(j)
            i, j, count = [], [], 0
    if count:
        yield np.concatenate(i), np.concatenate(j)


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut between groups (region, x, y): a group is bounded, however large its region."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        group = list(zip(batch["region"], batch["x"], batch["y"], strict=True))
        cut = len(group)
        while cut and group[cut - 1] == group[-1]:
            cut -= 1
        if held and (cut or (held[0]["region"].iat[-1], held[0]["x"].iat[-1], held[0]["y"].iat[-1]) != group[0]):
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _keyed(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """key (even where rows of one side are compared too), root, side, n."""
    region, x, y = (rows[c].to_numpy("i8") for c in ("region", "x", "y"))
    fresh = np.r_[True, (region[1:] != region[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    return (np.cumsum(fresh) * 2 + (x != 0), *(rows[c].to_numpy("i8") for c in ("root", "side", "n")))


def _open_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that may be similar to one of another component in their region."""
    for rows in _whole_groups(batches):
        key, root, side, n = _keyed(rows)
        sketches, found = _Sketches(rows["bits"].tolist()), np.zeros(len(rows), bool)
        for i, j in _bulk(_pairs(key, root, side, n)):
            good = _maybe(sketches, n, i, j)
            found[i[good]] = found[j[good]] = True
        yield rows.loc[found, ["region", "doc"]]


def _exact_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links on full sets (bits) that join all similar rows of each group to one component."""
    for rows in _whole_groups(batches):
        key, root, side, n = _keyed(rows)
        sets = [np.frombuffer(x, "u8") for x in rows["bits"]]
        sketches, doc, links = _Sketches([sketch(s) for s in sets]), rows["doc"].to_numpy("i8"), []
        upper: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := upper.get(x, x)) != x:
                upper[x] = upper.get(y, y)
                x = y
            return x

        for i, j in _bulk(_pairs(key, root, side, n)):
            good = _maybe(sketches, n, i, j)
            for s, t in zip(i[good].tolist(), j[good].tolist(), strict=True):
                x, y = top(int(root[s])), top(int(root[t]))
                if x != y and similar(sets[s], sets[t]):
                    upper[max(x, y)] = min(x, y)
                    links.append((max(doc[s], doc[t]), min(doc[s], doc[t])))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="i8")


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def across(rows: DataFrame, bodies: DataFrame, compare, schema: str) -> DataFrame:
    """Compare all pairs of rows (region, doc, n, root) that have one region and different roots. ``bodies`` (doc, bits) has
    what is compared. A region's largest component and the rest are each dealt to blocks of about BLOCK_ROWS, or BLOCK_MEMBERS if
    their sets are large; a task sees two blocks, of which one at least is of the rest, so no two rows of the largest component meet."""
    of_root = rows.groupBy("region", "root").agg(F.count("*").alias("c"), F.sum("n").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = of_root.groupBy("region").agg(
        F.count("*").alias("roots"), F.sum("c").alias("all"), F.max("c").alias("main"), F.max_by("root", F.struct("c", "root")).alias("main_root"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum("members").alias("all_members"), F.max_by("members", F.struct("c", "root")).alias("main_members"),
    )
    fits = (F.col("all") > 2) | (100 * F.col("least") >= PERCENT * F.col("most"))
    parts = ((F.col("main"), F.col("main_members"), "mains"), (F.col("all") - F.col("main"), F.col("all_members") - F.col("main_members"), "rests"))
    blocks = [F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(members / BLOCK_MEMBERS)).cast("int").alias(name) for rows, members, name in parts]
    mixed = sizes.filter((F.col("roots") > 1) & fits).select("region", "main_root", *blocks)
    bulk = F.col("root") == F.col("main_root")
    placed = rows.join(mixed, "region").withColumn("block", F.pmod(F.xxhash64("doc"), F.when(bulk, F.col("mains")).otherwise(F.col("rests"))).cast("int"))

    def cell(x, y):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    def upto(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    with_mains = F.transform(upto("mains"), lambda m: cell(m, F.col("block")))
    with_rests = F.transform(F.filter(upto("rests"), lambda r: r != F.col("block")), lambda r: cell(-1 - F.least(r, F.col("block")), F.greatest(r, F.col("block"))))
    cells = F.when(bulk, F.transform(upto("rests"), lambda r: cell(F.col("block"), r))).otherwise(F.concat(with_mains, with_rests))
    dealt = placed.select("region", "doc", "n", "root", F.when(bulk, -1).otherwise(F.col("block")).alias("side"), F.explode(cells).alias("cell"))
    full = dealt.join(bodies, "doc").select("region", "cell.x", "cell.y", "doc", "n", "root", "side", "bits")
    return full.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", F.desc("side")).mapInPandas(compare, schema)


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cell, held = None, {}
    for batch in batches:
        links = []
        for x, y, after, a, b, text in zip(*(batch[c].tolist() for c in ("x", "y", "after", "a", "b", "text")), strict=True):
            if (x, y) != cell:
                cell, held = (x, y), {}
            if not after:
                held[a] = shingles(text)
            elif similar(held[a], held[b]):
                links.append((a, b))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="i8")


def confirm(pairs: DataFrame, bodies: DataFrame, count: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar. Documents are dealt to blocks; each text goes once to each pair of
    blocks that has pairs of it, so a crowd's texts are not copied for each of its pairs. ``count`` bounds the documents."""
    blocks = F.lit(1 + count // BLOCK)
    placed = pairs.select(F.pmod(F.xxhash64("a"), blocks).alias("x"), F.pmod(F.xxhash64("b"), blocks).alias("y"), "a", "b")
    needed = placed.select("x", "y", F.col("a").alias("doc_id")).unionByName(placed.select("x", "y", F.col("b").alias("doc_id"))).distinct()
    sent = needed.join(bodies, "doc_id").select("x", "y", F.lit(0).alias("after"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    both = sent.unionByName(placed.select("x", "y", F.lit(1).alias("after"), "a", "b", F.lit(None).cast("string").alias("text")))
    return materialise(both.repartition("x", "y").sortWithinPartitions("x", "y", "after").mapInPandas(_confirmed, "a long, b long"))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc": batch["doc_id"], "bits": [shingles(t).tobytes() for t in batch["text"]]})


def one_text_each(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with one row, of the greatest text, for a doc_id that several rows have."""
    several = materialise(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not several.limit(1).count():
        return rows
    return without(rows, several).unionByName(rows.join(several, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of two-word shingles have a Jaccard similarity of PERCENT or more; a component's
    id is its least doc_id, which is the one kept. Of texts with equal sets one stands for all.

    A null or blank text has the empty set and is linked with nothing; a text of one word has the set of that word.
    Rows that repeat a doc_id are one document, of the greatest text. Rows without doc_id are linked with nothing, kept, and
    have no component. An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as result:
        return result(_near_duplicates(one_text_each(texts(docs))))


def _near_duplicates(rows: DataFrame) -> DataFrame:
    described = materialise(rows.select("doc_id", describe()("text").alias("d")).select("doc_id", "d.*"))
    firsts = [F.first(c).alias(c) for c in ("n", "region", "place", "bits")]
    classes = materialise(described.filter("s1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), *firsts))
    nodes, count = classes.select("doc", "n"), classes.count()

    def bodies_of(docs: DataFrame) -> tuple[DataFrame, int]:
        wanted = materialise(docs.toDF("doc_id").distinct())
        few = wanted.count()
        return rows.join(F.broadcast(wanted) if few <= BROADCAST_IDS else wanted, "doc_id", "left_semi"), few

    # neighbours in the orders
    ordered = classes.select("doc", "n", F.explode(F.arrays_zip("region", "place")).alias("o")).select("o.region", "o.place", "doc", "n")
    ordered = ordered.repartitionByRange(1 + TREES * count // RANGE_ROWS, "region", "place", "doc").sortWithinPartitions("region", "place", "doc")
    found = materialise(ordered.mapInPandas(_neighbours, "kind int, region long, a long, b long, depth long"))
    depths = found.filter("kind > 0").groupBy("kind", "a", "b").agg(F.sum("depth").alias("depth"))
    both = depths.select("kind", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "depth").select("kind", "p.a", "p.b", "depth")
    best = both.groupBy("kind", "a").agg(F.min_by("b", F.struct(-F.col("depth"), "b")).alias("b"))
    best = materialise(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    pairs = likely(best, classes)
    links = confirm(pairs, *bodies_of(pairs.select(F.explode(F.array("a", "b")))))

    # all that regions still hold across components
    roots = connected_components(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", F.coalesce("root", "doc").alias("root"))
    shared = materialise(found.filter("kind = 0").select("region", F.col("a").alias("doc")).join(rooted, "doc"))
    open_rows = materialise(across(shared, classes.select("doc", "bits"), _open_rows, "region long, doc long").distinct())
    wanted, few = bodies_of(open_rows.select("doc"))
    if few:
        sets = materialise(wanted.mapInPandas(_sets, "doc long, bits binary"))
        links = links.unionByName(materialise(across(open_rows.join(shared, ["region", "doc"]), sets, _exact_links, "a long, b long")))
    final = connected_components(links)

    labels = classes.select("s1", "s2", "doc").join(final, F.col("doc") == F.col("node"), "left").select("s1", "s2", F.coalesce("root", "doc").alias("root"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(labels, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, of one document of each near-duplicate group.

    A kept document that several rows have keeps one of them: of the greatest text, then of the greatest other columns.
    Rows without doc_id and rows of blank texts stay. An empty table stays empty; other columns may have any name.
    """
    with scratch(docs.sparkSession) as result:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
        several = materialise(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
        gone = materialise(near_duplicates(docs).filter("NOT kept").select("doc_id"))
        kept = without(docs, gone)
        if several.limit(1).count():
            name, row = fresh(docs, "several"), fresh(docs, "row")
            again = without_others(kept, several, name)
            key = F.struct(F.col("text"), *[F.to_json(F.struct(c)) for c in own_columns(docs)])
            one = again.groupBy(F.col("doc_id").alias(name)).agg(F.max_by(F.struct(*own_columns(docs)), key).alias(row))
            kept = without(kept, several).unionByName(one.select(f"{row}.*"))
        return result(kept)


def without_others(docs: DataFrame, doc_ids: DataFrame, name: str) -> DataFrame:
    return docs.join(doc_ids.toDF(name), F.col("doc_id").cast("long") == F.col(name), "left_semi")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: The same rows, for DuckDB, by comparing all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT sym.b, r.m FROM r JOIN sym ON sym.a = r.doc_id WHERE r.m < sym.b
), c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
