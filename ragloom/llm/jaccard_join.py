"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word n-grams; two documents link if their
Jaccard similarity reaches ``threshold`` percent. Equal sets are one node.

1. Filter. Tokens (64-bit n-gram hashes) have one global order: rare before
   frequent, then by hash. If two sets overlap enough, their prefixes, extended by
   ``m`` tokens, share at least m + 1 tokens. A rare token is a signature by
   itself; frequent tokens fall into ``m`` partitions, and every two of one
   partition are a signature: m + 1 shared tokens hit a rare one or put two into one
   partition, so no link is lost. ``m`` depends on the size class of the larger set;
   a set whose partners reach into the next class has signatures for both.
   Which tokens count as frequent is a matter of cost only, not of results.
2. Star. Each signature has one hub, its most typical member (aggregated before the
   shuffle). Both ends of any link meet at one hub, so it is enough to compare
   members with hubs: each member's symmetric difference from its hub is computed
   from the two texts. Members near enough link to the hub.
3. Rest. Of the members that don't, links to others of the same hub follow from
   the differences alone: |x ^ y| = |dx| + |dy| - 2 |dx & dy|. Hubs with large
   differences are cut into blocks, each block of far members against each block
   of members, with an inverted index inside; no pair is a row. Only edges that
   join parts not yet joined in the block are kept.
   Most members met their hub by chance and are like nothing there. Before any text
   moves, sketches tell: the parities of a set's tokens in about as many bits as it has
   tokens. Two sketches never differ in more bits than their sets in tokens, so who
   differs too much from the hub and from all its members goes, and no link with it;
   members that are only like each other get a hub among themselves.
4. Components of the links by alternating stars.

Defined results: a null or wordless text has an empty set and links with nothing;
fewer words than ``width`` are one n-gram of their own; rows that share an id are
one node if their sets are equal, and in any case one component; a null id links
with nothing and has a null component; repeated rows are each kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, map_texts, runs_of, slices, written
from .components import components

#: At most this many frequent tokens are told apart, the most frequent ones.
FREQUENT = 1 << 18
#: A token is frequent from so many occurrences among the prefixes on.
OFTEN = 32
#: Ids up to this many are broadcast (16 MB), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A size class 2^c has 2^c / SPREAD partitions of the frequent tokens.
SPREAD = 16
#: Members of a hub compared in one run; tokens of differences in one block.
RUN, BLOCK = 2000, 1 << 20
#: Eight-byte words of sketches in one block.
SKETCHES = 1 << 14
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """word -> 62-bit hash; the table is bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word) >> 2
        return got


_WORDS = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; A-Z lower-cased."""
    claim("jaccard_join", _WORDS.clear)
    cut = [t.lower().split() for t in texts]
    h = np.array([_WORDS[w] for c in cut for w in c], np.int64).view(np.uint64)
    odd = [np.uint64(int(_MIX[i % 3]) * (2 * i + 1) % (1 << 64)) for i in range(width)]

    def grams(part, k):
        acc = np.full(max(0, len(part) - k + 1), np.uint64(k))
        for i in range(k):
            acc += part[i:i + len(acc)] * odd[i]
        return mix(acc)

    whole, out, at = grams(h, width), [], 0
    for c in cut:
        n = len(c)
        out.append(np.unique(whole[at:at + n - width + 1]) if n >= width
                   else grams(h[at:at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    return shingle_sets([text], width)[0]


def size_class(n: int) -> int:
    return n.bit_length() - 1


def spread_of(c: int) -> int:
    """Partitions of the frequent tokens (and tokens a prefix is extended by) in a class."""
    return (1 << c) // SPREAD if c >= 5 else 0


def least_overlap(n: int, percent: int) -> int:
    """Smallest overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def head_length(n: int, percent: int, c: int) -> int:
    return min(n, n - least_overlap(n, percent) + 1 + spread_of(c))


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int):
    """Of a sorted token set: (class, rare signatures, pair signatures, frequent tokens in the
    prefix) for each size class it takes part in, and how many frequent tokens it has."""
    n = len(tokens)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
    else:
        often = np.zeros(n, bool)
    order = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])
    own = size_class(n)
    out = []
    for c in ([own, own + 1] if 100 * n // percent >= 2 << own else [own]):
        prefix = order[:head_length(n, percent, c)]
        m = spread_of(c)
        salt = [np.uint64((c + 1) * int(k) % (1 << 64)) for k in _MIX]
        rare = prefix[~often[prefix]] if m else prefix
        pairs = []
        f = tokens[prefix[often[prefix]]] if m else tokens[:0]
        if len(f):
            part = (f >> np.uint64(7)) % np.uint64(m)
            o = np.argsort(part, kind="stable")
            f, part = f[o], part[o]
            step = 1
            while step < len(f):    # the step-th next token of the same partition
                same = part[:-step] == part[step:]
                if not same.any():
                    break
                x, y = f[:-step][same], f[step:][same]
                pairs.append(mix(mix(np.minimum(x, y) + salt[1]) ^ np.maximum(x, y)))
                step += 1
        out.append((c, mix(tokens[rare] + salt[0]),
                    np.unique(np.concatenate(pairs)) if pairs else tokens[:0], len(f)))
    return out, int(often.sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of how many tokens fall to each of 2^c bits, c the size class; 64 bits at least."""
    bits = max(64, 1 << size_class(max(1, len(tokens))))
    place = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of numbers, all as narrow as the narrowest: a wider one's parts add up."""
    wide = min(map(len, sketches), default=8) // 8
    out = np.empty((len(sketches), wide), np.uint64)
    for i, raw in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, wide), axis=0)
    return out


def may_link(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the ``others`` the set of ``n`` tokens may link with, by their sketches."""
    differ = np.maximum(np.bitwise_count(others ^ one).sum(1, dtype=np.int64), np.abs(sizes - n))
    return (100 + percent) * differ <= (100 - percent) * (sizes + n)


def node_table(docs: DataFrame, width: int) -> DataFrame:
    """(_id, n_shingles, digest, sketch) per row; no digest and sketch for an empty set."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(rows, texts):
        sets = shingle_sets(texts, width)
        return [rows.column(0), [len(s) for s in sets],
                [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                 for s in sets], [sketch(s) if len(s) else None for s in sets]]

    return map_texts(docs, ["_id"], run, f"_id {kind}, n_shingles long, digest binary, sketch binary")


def frequent_tokens(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Tokens often met at the head of sets, sorted; at most ``FREQUENT``."""

    def run(batches):
        held, n = [], 0

        def flush():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            more = times > 1
            return pa.RecordBatch.from_arrays([_signed(token[more]), pa.array(times[more])],
                                              names=["token", "n"])

        for _, texts in slices(batches):
            for s in shingle_sets(texts, width):
                held.append(s[:2 * head_length(len(s), percent, size_class(max(1, len(s))))])
                n += len(held[-1])
            if n > 1 << 22:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    top = (docs.select("text").mapInArrow(run, "token long, n long").groupBy("token")
           .agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
           .orderBy(F.desc("n"), "token").limit(FREQUENT).select("token"))
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


def hub_members(signed: DataFrame, percent: int) -> DataFrame:
    """(hub, _id): for each signature, its members and the most typical of them.

    Most signatures have one member and go first. Then a set needs m + 1 shared tokens
    in its prefix to have any partner: those that are left and the frequent ones in it.
    Of what remains, only sets whose sizes allow a link meet."""
    # a signature of two sets goes unless their sizes allow a link
    shared = (signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"),
                                        F.max("size").alias("high"))
              .where((F.col("n") > 2) | (F.col("n") == 2) & (100 * F.col("low") >= percent * F.col("high")))
              .select("sig"))
    # what describes the set travels as two numbers
    met = signed.select("sig", "_id", (F.col("size").cast("long") * 128 + F.col("class") * 2
                                       + F.col("rare").cast("int")).alias("x"),
                        (F.col("held").cast("long") * 1024 + F.col("often")).alias("y")).join(shared, "sig")
    c, size = F.shiftright("x", 1).bitwiseAND(F.lit(63)), F.shiftright("x", 7)
    m = F.when(c >= 5, F.floor(F.pow(F.lit(2), c) / SPREAD)).otherwise(0)
    have = F.sum(F.col("x").bitwiseAND(F.lit(1))).over(Window.partitionBy("_id", c))
    # a little wider than the largest ratio of linked sizes: partners are one step apart at most
    step = F.floor(F.log(size.cast("double")) / F.log(F.lit(101.0 / percent)))
    often = F.col("y").bitwiseAND(F.lit(1023)).alias("often")
    rows = written(met.withColumn("have", have).where(F.col("have") + F.shiftright("y", 10) > m).select(
        "sig", "_id", often, F.explode(F.array(step, step + 1)).alias("step")), "shared")
    hubs = (rows.groupBy("sig", "step")
            .agg(F.max(F.struct("often", "_id")).alias("top"),
                 F.min("_id").alias("a"), F.max("_id").alias("b"))
            .where("a != b").select("sig", "step", F.col("top._id").alias("hub")))
    return rows.join(hubs, ["sig", "step"]).where("_id != hub").select("hub", "_id").distinct()


def in_blocks(rows: DataFrame, words: F.Column, limit: int, cols: list[str]) -> DataFrame:
    """(hub, i, j, side, cols): the ``far`` rows of a hub (side 0) in blocks i against all its
    rows (side 1) in blocks j of about ``limit`` words; of hubs with far rows."""
    hubs = (rows.groupBy("hub").agg(F.sum(words).alias("w"), F.sum(F.when(F.col("far"), words)).alias("v"))
            .where("v is not null").select("hub", F.ceil(F.col("v") / limit).alias("lefts"),
                                           F.ceil(F.col("w") / limit).alias("rights")))
    rows = rows.join(hubs, "hub")
    own = F.xxhash64("_id", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("far").select("hub", F.pmod(own, F.col("lefts")).alias("i"),
                                    every("rights").alias("j"), F.lit(0).alias("side"), *cols)
    right = rows.select("hub", every("lefts").alias("i"), F.pmod(own, F.col("rights")).alias("j"),
                        F.lit(1).alias("side"), *cols)
    return (left.unionByName(right).repartition("hub", "i", "j")
            .sortWithinPartitions("hub", "i", "j", "side", "_id"))


def new_stars(far: list, others: list, percent: int) -> list[tuple]:
    """(hub, id): stars around some far members in which each two that may link, one of ``far``
    and one of ``others``, meet. Rows are (id, size, sketch).

    A member whose pairs are not all within earlier stars is the hub of one more; so alike
    members share one star."""
    rows = far + others
    table = folded([r[2] for r in rows])
    size, ident = np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows])
    hubs, reach, held = [], np.zeros((0, len(rows)), bool), []
    for k, (x, n, _) in enumerate(far):
        alike = may_link(table[k], n, table, size, percent) & (ident != x)
        left = alike.copy()
        left[:len(far)] = False
        for h in np.flatnonzero(reach[:len(hubs), k]):
            met = left & reach[h]
            if met.any():
                held[h] |= met
                held[h][k] = True
                left &= ~met
        if left.any():
            if len(hubs) == len(reach):
                reach = np.concatenate([reach, np.zeros((len(hubs) + 8, len(rows)), bool)])
            reach[len(hubs)] = alike
            hubs.append(x)
            held.append(left)
    return list({(h, rows[k][0]) for h, mask in zip(hubs, held) for k in np.flatnonzero(mask)})


def likely(stars: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(hub, _id): stars in which all members of one of ``stars``, its hub included, meet whom they
    may link with. Members like their hub stay with it; the others meet in stars of their own."""
    kind = stars.schema["_id"].dataType.simpleString()
    of = nodes.where("sketch is not null").select("_id", F.col("n_shingles").alias("size"), "sketch")
    few = stars.count() <= BROADCAST_IDS
    hubs = stars.select(F.col("hub").alias("_id")).distinct()
    members = of.join(F.broadcast(stars) if few else stars, "_id").select("hub", "_id", "size", "sketch")
    middle = of.join(F.broadcast(hubs) if few else hubs, "_id").select(
        F.col("_id").alias("hub"), F.col("size").alias("hub_size"), F.col("sketch").alias("hub_sketch"))

    def compare(batches):
        for b in batches:
            hub, ident, size, one, n, other = (b.column(c) for c in range(6))
            far = []
            for s, x, m, y in zip(*(c.to_pylist() for c in (size, one, n, other))):
                x, y = folded([x, y])
                far.append(not may_link(x, s, y[None], np.array([m]), percent)[0])
            yield pa.RecordBatch.from_arrays([hub, ident, size, one, pa.array(far, pa.bool_())],
                                             names=["hub", "_id", "size", "sketch", "far"])

    rows = written(members.join(middle.distinct(), "hub").distinct().mapInArrow(
        compare, f"hub {kind}, _id {kind}, size long, sketch binary, far boolean"), "sketched")

    def meet(batches):
        for _, group in runs_of(batches, 3):
            far, others = [], []
            for _, _, _, side, *row in group:
                (others if side else far).append(row)
            found = new_stars(far, others, percent) if far and others else []
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["hub", "_id"])

    several = rows.groupBy("hub").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a != b")
    met = in_blocks(rows.join(several.select("hub"), "hub", "left_semi"),
                    F.octet_length("sketch") / 8 + 8, SKETCHES, ["_id", "size", "sketch"])
    return (rows.where("not far").select("hub", "_id")
            .unionByName(met.mapInArrow(meet, f"hub {kind}, _id {kind}")).distinct())


def differences(docs: DataFrame, stars: DataFrame, width: int) -> DataFrame:
    """(hub, id, size, hub_size, far, delta): each member's symmetric difference from its hub."""
    kind = docs.schema["_id"].dataType.simpleString()
    runs = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    members = stars.join(runs, "hub").select(
        "hub", F.pmod(F.xxhash64("_id"), F.col("runs")).cast("int").alias("run"), "_id",
        F.lit(1).alias("member"))
    hubs = runs.select("hub", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"),
                       F.col("hub").alias("_id"), F.lit(0).alias("member"))
    wanted = written(members.unionByName(hubs), "stars")
    few = wanted.count() <= BROADCAST_IDS
    rows = (docs.join(F.broadcast(wanted) if few else wanted, "_id")
            .select("hub", "run", "member", "_id", "text"))

    def run(batches):
        for (hub, _), group in runs_of(batches, 2):
            middle = None
            out = []
            for _, _, member, ident, text in group:
                s = shingles(text.encode(), width)
                if not member:
                    middle = s if middle is None else middle
                    continue
                d = np.setxor1d(s, middle, assume_unique=True)
                out.append((hub, ident, len(s), len(middle), d.tobytes()))
                if len(out) == 200:
                    yield out
                    out = []
            yield out

    def arrow(batches):
        for out in run(batches):
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                    names=["hub", "_id", "size", "hub_size", "delta"])

    return (rows.where("text is not null").repartition("hub", "run")
            .sortWithinPartitions("hub", "run", "member", "_id")
            .mapInArrow(arrow, f"hub {kind}, _id {kind}, size long, hub_size long, delta binary"))


def block_links(far_rows: list, rows: list, percent: int) -> list[tuple]:
    """Links between far members and members of one hub, as few as join them.

    Rows are (id, size, delta). 100 |x & y| >= percent |x | y| in terms of the
    symmetric difference s and the sizes: s (100 + percent) <= (100 - percent)(|x| + |y|)."""
    a, b = 100 + percent, 100 - percent
    size = np.array([r[1] for r in rows], np.int64)
    delta = [np.frombuffer(r[2], np.uint64) for r in rows]
    wide = np.array([len(d) for d in delta], np.int64)
    token = np.concatenate(delta) if delta else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), wide)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    label = np.arange(len(rows))
    slack = a * wide - b * size    # the member that a far one reaches without a common token
    best = int(slack.argmin()) if len(rows) else -1
    place = {r[0]: i for i, r in enumerate(rows)}
    links = []
    for ident, n, raw in far_rows:
        d = np.frombuffer(raw, np.uint64)
        lo, hi = np.searchsorted(token, d, "left"), np.searchsorted(token, d, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(rows))
        ok = a * (len(d) + wide - 2 * common) <= b * (n + size)
        me = place.get(ident, -1)
        if me >= 0:
            ok[me] = False
        if best >= 0 and best != me and a * len(d) - b * n + slack[best] <= 0:
            ok[best] = True
        hit = np.flatnonzero(ok)
        if not len(hit):
            continue
        parts, first = np.unique(label[hit], return_index=True)
        if me >= 0:
            other = parts != label[me]
            parts, first = parts[other], first[other]
        links += [(ident, rows[hit[i]][0]) for i in first]
        if me >= 0:
            label[np.isin(label, parts)] = label[me]
        else:
            label[np.isin(label, parts)] = parts[0] if len(parts) else 0
    return links


def far_links(deltas: DataFrame, percent: int) -> DataFrame:
    """(u, v) links of members that are far from their hub."""
    kind = deltas.schema["_id"].dataType.simpleString()
    def run(batches):
        for _, group in runs_of(batches, 3):
            far, rows = [], []
            for _, _, _, side, *row in group:
                (rows if side else far).append(row)
            links = block_links(far, rows, percent) if far else []
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return (in_blocks(deltas, F.octet_length("delta") / 8 + 8, BLOCK, ["_id", "size", "delta"])
            .mapInArrow(run, f"u {kind}, v {kind}"))


def similar_groups(docs: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = src.schema["_id"].dataType.simpleString()
    nodes = written(node_table(src, width), "nodes")
    known = nodes.where("digest is not null and _id is not null")
    first = known.groupBy("digest").agg(F.min("_id").alias("node"))
    # rows that share an id but not their words: one component
    twice = (known.groupBy("_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
             .where("a != b").select("_id"))
    node_of = written(known.select("_id", "digest").distinct().join(first, "digest")
                      .select("_id", "digest", "node"), "node-of")
    copies = written(node_of.groupBy("_id").agg(F.max(F.col("node") == F.col("_id")).alias("first"))
                     .where("not first").select("_id"), "copies")
    few = copies.count() <= BROADCAST_IDS
    alone = src.where("_id is not null and text is not null").join(
        F.broadcast(copies) if few else copies, "_id", "left_anti")
    frequent = frequent_tokens(alone, width, percent)
    shared = src.sparkSession.sparkContext.broadcast(frequent)   # at most FREQUENT numbers

    def sign(rows, texts):
        take, sig, info = [], [], []
        for i, s in enumerate(shingle_sets(texts, width)):
            if not len(s):
                continue
            classes, often = signatures(s, shared.value, percent)
            for c, rare, pairs, held in classes:
                for one, got in ((True, rare), (False, pairs)):
                    take.append(np.full(len(got), i))
                    sig.append(got)
                    info.append((len(got), len(s), c, one, held, often * 1000 // len(s)))
        if not sig:
            return [rows.column(0).slice(0, 0), *[[]] * 6]
        times, *cols = (np.array(x) for x in zip(*info))
        return [rows.column(0).take(pa.array(np.concatenate(take))), _signed(np.concatenate(sig)),
                *(pa.array(np.repeat(x, times)) for x in cols)]

    signed = written(map_texts(alone, ["_id"], sign, f"_id {kind}, sig long, size int, class int, "
                               "rare boolean, held int, often int"), "signatures")
    stars = written(likely(written(hub_members(signed, percent), "members"), nodes, percent), "likely")
    far = (100 + percent) * F.octet_length("delta") / 8 > (100 - percent) * (F.col("size") + F.col("hub_size"))
    deltas = written(differences(alone, stars, width).withColumn("far", far), "differences")
    links = (deltas.where("not far").select(F.col("_id").alias("u"), F.col("hub").alias("v"))
             .unionByName(far_links(deltas, percent))
             .unionByName(node_of.join(twice, "_id").select(F.col("_id").alias("u"),
                                                            F.col("node").alias("v"))))
    comp = components(written(links, "links"))
    ids = (node_of.groupBy("_id").agg(F.min("node").alias("node"))
           .join(comp.withColumnRenamed("u", "node"), "node", "left")
           .select("_id", F.coalesce("component", "node").alias("component_id")))
    return (nodes.join(ids, "_id", "left")
            .select(F.col("_id").alias(id_col), "n_shingles",
                    F.coalesce("component_id", "_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each group: that with the smallest id."""
    groups = similar_groups(docs, id_col=id_col, **options)
    gone = written(groups.where(F.col(id_col) != F.col("component_id"))
                   .select(F.col(id_col).alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone["_gone"], "left_anti")
    ids = groups.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count()
    if ids.where("count > 1").limit(1).count():   # rows that repeat an id: one of them
        kept = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(
            kept.where(F.col(id_col).isNull()))
    return kept
