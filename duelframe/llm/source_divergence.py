"""Source divergence audit: how far the words of each source of a language are from those of the others.

First pass: exact document frequencies of (lang, term), summed in tasks and then by key; terms in at least `least`
documents are kept. Their keys, the most frequent first, go into perfect hashes: levels of bit maps in which a key that
meets no other takes its place (its rank among the set bits is its slot), sharded by a hash of the key and built by a task a
shard. Shards of at most `head_bytes` of keys are broadcast with the keys themselves, so that every hit is compared with
the stored key. Second pass: tasks count the terms of a batch, look the distinct ones up in one go and add them to dense
slots of their group, of which a task holds `slot_bytes`; groups beyond that hand their counts of a batch on at once, and
so do terms beyond the broadcast head. All sums meet by key, so both bounds change no result.

Pairs of sources are compared in square tiles of sources and shards of terms: a task adds up a tile's terms and hands on
sums; terms that no source of a tile has are all alike and added once. Only sums of the size of the result travel.

Defined results: null text, lang and source are empty strings; every row is a document, repeated ids and rows too; a group
without terms has pairs and no term rows; a language without kept terms has pairs of value 0; the only source of a language
has no pair; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import materialize

from .common import parts, settle, share, shared, spread, text_or_empty

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
HEAD_BYTES, SHARD_KEYS, SLOT_BYTES = 64 << 20, 1 << 16, 128 << 20
TILE, TERM_SHARDS = 64, 64
# Terms, and words, that a task counts before it hands them on or adds them to its slots; rows of a tile taken at once.
HELD, HELD_WORDS, TILE_ROWS = 500_000, 1 << 24, 50_000

# A-Z to a-z; what ends a term to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list:
    """Runs of ASCII letters and of characters beyond ASCII; as no such character has an ASCII byte, bytes will do."""
    return text.translate(_FOLD).split()


def _bytes(column):
    return column.cast(pa.binary()).to_pylist()


def _rows(names, keys, terms, numbers):
    """A batch of constant keys, then terms and their numbers."""
    n = len(numbers)
    columns = [*[pa.repeat(pa.scalar(k, pa.binary()), n) for k in keys], terms if isinstance(terms, pa.Array) else pa.array(terms, pa.binary()), pa.array(numbers, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _frequencies(batches):
    """(lang, term, docs) of a task's documents, handed on whenever `HELD` terms are held."""
    by: dict = {}

    def out():
        for lang, counter in by.items():
            yield _rows(["lang", "term", "docs"], [lang], list(counter), list(counter.values()))

    for batch in batches:
        for lang, text in zip(_bytes(batch.column(0)), _bytes(batch.column(1))):
            by.setdefault(lang, Counter()).update(set(terms_of(text)))
        if sum(map(len, by.values())) >= HELD:
            yield from out()
            by = {}
    yield from out()


def kept_terms(rows: DataFrame, least=LEAST) -> DataFrame:
    """(lang, term, docs) of the terms in at least `least` documents of their language; `rows` has lang, source, text."""
    counted = rows.select("lang", "text").mapInArrow(_frequencies, "lang binary, term binary, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)


# -- perfect hashes ---------------------------------------------------------------------------------

def _level(hashes, level, sizes):
    return (spread(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % sizes.astype(np.uint64)).astype(np.int64)


def build_levels(hashes: np.ndarray) -> tuple:
    """(places, level sizes): the slot of each distinct hash, from 0 without a gap, and the bit maps, one a level.

    At each level the keys that meet no other at their bit stay; the others go to the next, as large as they are many."""
    slots, left, maps, base = np.empty(len(hashes), np.int64), np.arange(len(hashes)), [], 0
    while len(left):
        size = len(left) + len(left) // 4 + 1
        at = _level(hashes[left], len(maps), np.full(len(left), size))
        alone = np.bincount(at, minlength=size) == 1
        rank = base + np.cumsum(alone) - 1
        stays = alone[at]
        slots[left[stays]] = rank[at[stays]]
        base += int(alone.sum())
        maps.append(alone)
        left = left[~stays]
    return slots, maps


def _keyed(lang: bytes, term: bytes) -> bytes:
    return lang + b"\0" + term  # no term has a zero byte


def _build(shards):
    """(shard, term) rows sorted by shard: a row for each shard with its levels and its keys by slot."""
    def built(shard, keys):
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two kept terms share a 64-bit hash")
        slots, maps = build_levels(hashes)
        by_slot = pa.array(keys, pa.binary()).take(pa.array(np.argsort(slots)))
        offsets = pa.array([0, len(keys)], pa.int32())
        sizes = pa.ListArray.from_arrays(pa.array([0, len(maps)], pa.int32()), pa.array([len(m) for m in maps], pa.int64()))
        bits = np.packbits(np.concatenate(maps)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), sizes, pa.array([bits], pa.binary()), pa.ListArray.from_arrays(offsets, by_slot)],
                                          names=["shard", "sizes", "bits", "keys"])

    open_, held = None, []
    for batch in shards:
        for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != open_ and held:
                yield built(open_, held)
                held = []
            open_ = shard
            held.append(key)
    if held:
        yield built(open_, held)


class Slots:
    """All shards as one: a key's slot, or -1 where the stored key is another. A language's slots are numbered from 0."""

    def __init__(self, ways: int, rows: list):
        """rows: (shard, level sizes, packed bits, keys by slot)."""
        rows = {r[0]: r for r in rows}
        depth = max([len(r[1]) for r in rows.values()], default=0)
        self.ways, self.sizes, self.starts, bits, keys, base = ways, np.ones((ways, depth), np.int64), np.zeros((ways, depth), np.int64), [], [], 0
        for shard in range(ways):
            for level in range(depth):
                size = rows[shard][1][level] if shard in rows and level < len(rows[shard][1]) else 0
                self.sizes[shard, level], self.starts[shard, level] = max(size, 1), base
                base += size
            if shard in rows:
                bits.append(np.unpackbits(np.frombuffer(rows[shard][2], np.uint8))[:sum(rows[shard][1])].astype(bool))
                keys += rows[shard][3]
        # One bit more, never set, for levels that a shard does not have.
        self.bits = np.concatenate([*bits, [False]])
        self.starts = np.minimum(self.starts, len(self.bits) - 1)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.keys = pa.array(keys, pa.binary())
        self.terms = pa.array([k[k.rindex(b"\0") + 1:] for k in keys], pa.binary())
        langs = np.array([k[:k.rindex(b"\0")] for k in keys], object)
        self.place, self.of_lang = np.empty(len(keys), np.int64), {}
        for lang in set(langs):
            at = np.nonzero(langs == lang)[0]
            self.place[at] = np.arange(len(at))
            self.of_lang[lang] = at

    def find(self, keys: list) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not keys:
            return found
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shard = (hashes % np.uint64(self.ways)).astype(np.int64)
        left = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            s = shard[left]
            at = np.minimum(self.starts[s, level] + _level(hashes[left], level, self.sizes[s, level]), len(self.bits) - 1)
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        candidates = np.nonzero(found >= 0)[0]
        same = pc.equal(self.keys.take(pa.array(found[candidates])), pa.array(keys, pa.binary()).take(pa.array(candidates)))
        found[candidates[~same.to_numpy(zero_copy_only=False)]] = -1
        return found


def perfect_hashes(head: DataFrame, shard_keys=SHARD_KEYS) -> Slots:
    """The perfect hashes of (lang, term) rows, whose bytes the caller bounds; a task builds a shard."""
    ways = max(1, -(-head.count() // shard_keys))

    def keyed(batches):
        for batch in batches:
            keys = [_keyed(a, b) for a, b in zip(_bytes(batch.column(0)), _bytes(batch.column(1)))]
            shard = pa.array([xxhash.xxh3_64_intdigest(k) % ways for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, pa.array(keys, pa.binary())], names=["shard", "key"])

    dealt = head.select("lang", "term").mapInArrow(keyed, "shard int, key binary").repartition(ways, "shard").sortWithinPartitions("shard")
    built = materialize(dealt.mapInArrow(_build, "shard int, sizes array<long>, bits binary, keys array<binary>"), "div-shards")
    return Slots(ways, [(r.shard, r.sizes, bytes(r.bits), [bytes(k) for k in r["keys"]]) for r in built.toLocalIterator()])


# -- the second pass --------------------------------------------------------------------------------

def _recount(sent, with_tail, slot_bytes):
    names = ["lang", "source", "term", "n"]

    def run(batches):
        slots = shared(sent)
        dense: dict = {}
        counts: dict = {}
        room, words, added = slot_bytes, 0, 0

        def listed(lang, source, places, numbers):
            return _rows(names, [lang, source], slots.terms.take(pa.array(slots.of_lang[lang][places])), numbers)

        def add():
            """The counted terms go to their slots; what has none there is handed on."""
            nonlocal room
            for lang, by_source in counts.items():
                for source, counter in by_source.items():
                    places = slots.find([_keyed(lang, t) for t in counter])
                    numbers = np.fromiter(counter.values(), np.int64, len(counter))
                    known = places >= 0
                    if with_tail and not known.all():
                        yield _rows(names, [lang, source], [t for t, k in zip(counter, known.tolist()) if not k], numbers[~known])
                    places, numbers = slots.place[places[known]], numbers[known]
                    if not len(places):
                        continue
                    size = 4 * len(slots.of_lang[lang])
                    if (lang, source) not in dense and size <= room:
                        dense[lang, source] = np.zeros(size // 4, np.uint32)
                        room -= size
                    if (lang, source) in dense:
                        dense[lang, source][places] += numbers.astype(np.uint32)  # distinct terms, distinct places
                    else:
                        yield listed(lang, source, places, numbers)

        def emptied():
            for (lang, source), numbers in dense.items():
                places = np.nonzero(numbers)[0]
                for at in range(0, len(places), 1 << 18):
                    part = places[at:at + (1 << 18)]
                    yield listed(lang, source, part, numbers[part].astype(np.int64))

        for batch in batches:
            for lang, source, text in zip(*map(_bytes, batch.columns)):
                terms = terms_of(text)
                words += len(terms)
                counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
            if words >= HELD_WORDS or sum(len(c) for by in counts.values() for c in by.values()) >= HELD:
                yield from add()
                added += words
                counts, words = {}, 0
                if added >= 1 << 31:  # before a slot of 32 bits can be full
                    yield from emptied()
                    dense, room, added = {}, slot_bytes, 0
        yield from add()
        yield from emptied()
    return run


def group_counts(rows: DataFrame, kept: DataFrame, head_bytes=HEAD_BYTES, slot_bytes=SLOT_BYTES, shard_keys=SHARD_KEYS) -> DataFrame:
    """(lang, source, term, n) of the kept terms that a group has; `rows` has lang, source, text."""
    # Powers of two of the frequency, at most 64 of them: the frequent ones whose keys fit are the head.
    scale = F.floor(F.log2("docs")).cast("int")
    sizes = kept.groupBy(scale.alias("scale")).agg(F.sum(F.octet_length("lang") + F.octet_length("term") + 64).alias("size"), F.count("*").alias("n"))
    lowest, used, rest = 64, 0, False
    for r in sorted(sizes.collect(), key=lambda r: -r.scale):
        used += r["size"]
        rest = rest or used > head_bytes
        lowest = lowest if rest else r.scale
    head = kept.filter(scale >= lowest)
    sent = share(rows.sparkSession, perfect_hashes(head, shard_keys))
    found = rows.select("lang", "source", "text").mapInArrow(_recount(sent, rest, slot_bytes), "lang binary, source binary, term binary, n long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi") if rest else found


# -- shares and divergences -------------------------------------------------------------------------

def _share(count, total, terms, scale):
    """1 + floor(scale * (count + 1) / (total + terms)), exact beyond 64 bits; null without terms."""
    among = F.when(terms > 0, total + terms)
    short = F.call_function("div", F.lit(scale).cast("long") * (count + 1), among)
    long = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), among.cast("decimal(20,0)"))
    return F.when(count < (1 << 62) // scale, short).otherwise(long.cast("long")) + 1


def _tiles(block):
    """Rows sorted by lang, tile (x, y), shard, term (null first: the sources with their share of an absent term):
    (lang, s, t, value, seen, plain): for every two sources of a tile the sum over the terms that some source of it has,
    their number, and the value of a term that neither has."""
    def out(lang, sides, sums, seen):
        rows = []
        for (p, q), total in sums.items():
            a, b = sides[p], sides[q]
            plain = (a[1][:, None] - b[1][None, :]) ** 2 // b[1][None, :]
            for i, s in enumerate(a[0]):
                rows += [(lang, s, t, int(total[i, j]), seen, int(plain[i, j])) for j, t in enumerate(b[0]) if s != t]
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                                          names=["lang", "s", "t", "value", "seen", "plain"])

    def opened(key, sources, plain):
        """The sides of a tile from its header, and sums for its two directions (one, if it lies on the diagonal)."""
        sides = {}
        for side in dict.fromkeys(key[1:3]):
            own = np.nonzero(sources // block == side)[0]
            own = own[np.argsort(sources[own])]
            sides[side] = (sources[own].tolist(), plain[own], sources[own])
        pairs = dict.fromkeys([(key[1], key[2]), (key[2], key[1])])
        return sides, {(p, q): np.zeros((len(sides[p][0]), len(sides[q][0])), np.int64) for p, q in pairs}

    def add(sides, sums, term_no, sources, shares):
        """Whole terms, numbered from 0."""
        for begin in range(0, int(term_no[-1]) + 1, 4096):
            here = (term_no >= begin) & (term_no < begin + 4096)
            no, own, p = term_no[here] - begin, sources[here], shares[here]
            matrix = {}
            for side, (_, plain, known) in sides.items():
                m = matrix[side] = np.repeat(plain[None, :], int(no[-1]) + 1, 0)
                mine = own // block == side
                m[no[mine], np.searchsorted(known, own[mine])] = p[mine]
            for (x, y), total in sums.items():
                a, b = matrix[x], matrix[y]
                for i in range(a.shape[1]):
                    total[i] += ((a[:, i, None] - b) ** 2 // b).sum(0)

    def run(batches):
        key, sides, sums, seen, held = None, None, None, 0, []

        def rows(table, last):
            """Takes all but the last (key, term) of the table, or all; returns the rest."""
            nonlocal key, sides, sums, seen
            n = len(table)
            keys = [table.column(c).to_numpy() for c in ("x", "y", "shard")]
            lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
            new_key = np.ones(n, bool)
            new_key[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            for k in keys:
                new_key[1:] |= k[1:] != k[:-1]
            same_term = pc.fill_null(pc.equal(term[1:], term[:-1]), False).to_numpy(zero_copy_only=False)
            absent = pc.is_null(term).to_numpy(zero_copy_only=False)
            new_term = new_key.copy()
            new_term[1:] |= ~(same_term | (absent[1:] & absent[:-1]))
            stop = n if last else int(np.nonzero(new_term)[0][-1])
            source, p = table.column("no").to_numpy().astype(np.int64), table.column("p").to_numpy()
            begins = np.nonzero(new_key[:stop])[0]
            for begin, end in zip(begins, np.append(begins[1:], stop)):
                now = (lang[begin].as_py(), *[int(k[begin]) for k in keys])
                if now != key:
                    if key is not None:
                        yield out(key[0], sides, sums, seen)
                    heads = begin + int(absent[begin:end].sum())
                    key, seen = now, 0
                    sides, sums = opened(key, source[begin:heads], p[begin:heads])
                    begin = heads
                if begin < end:
                    no = np.cumsum(new_term[begin:end] | (np.arange(begin, end) == begin)) - 1
                    seen += int(no[-1]) + 1
                    add(sides, sums, no, source[begin:end], p[begin:end])
            return table.slice(stop)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= TILE_ROWS:
                held = [(yield from rows(pa.concat_tables(held), False))]
        if sum(map(len, held)):
            yield from rows(pa.concat_tables(held), True)
        if key is not None:
            yield out(key[0], sides, sums, seen)
    return run


def pair_values(shares: DataFrame, groups: DataFrame, tile=TILE, term_shards=TERM_SHARDS) -> DataFrame:
    """(lang, s, t, value) for every two sources of a language, by number. `shares`: lang, no, term, p of the terms that a
    source has; `groups`: lang, no, plain (its share of an absent term), terms (of the language)."""
    spark = groups.sparkSession
    blocks = groups.groupBy("lang").agg((F.floor(F.max("no") / tile) + 1).cast("int").alias("blocks"))
    columns = lambda df, term, p: df.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", F.least(F.floor(F.col("no") / tile).cast("int"), "other").alias("x"), F.greatest(F.floor(F.col("no") / tile).cast("int"), "other").alias("y"),
        "shard", term.alias("term"), "no", p.alias("p"))
    marked = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(term_shards - 1))))
    heads = columns(marked, F.lit(None).cast("binary"), F.coalesce("plain", F.lit(1)).cast("long"))
    rows = columns(shares.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(term_shards)).cast("int")), F.col("term"), F.col("p"))
    dealt = heads.unionByName(rows).repartition(parts(spark), "lang", "x", "y", "shard")
    dealt = dealt.sortWithinPartitions("lang", "x", "y", "shard", F.col("term").asc_nulls_first())
    sums = dealt.mapInArrow(_tiles(tile), "lang binary, s int, t int, value long, seen long, plain long")
    sums = sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("plain").alias("plain"))
    terms = groups.groupBy("lang").agg(F.max("terms").alias("terms"))
    return sums.join(terms, "lang").select("lang", "s", "t", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("plain")).alias("value"))


def divergence(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", least=LEAST, scale=SCALE, top=TOP,
               head_bytes=HEAD_BYTES, slot_bytes=SLOT_BYTES, shard_keys=SHARD_KEYS, tile=TILE, term_shards=TERM_SHARDS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by its distance (`pair`), and the `top`
    terms that the source has more of than the language (`term`)."""
    settle(docs.sparkSession)
    rows = docs.select(*[text_or_empty(c).cast("binary").alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = materialize(kept_terms(rows, least), "div-kept")
    counts = materialize(group_counts(rows, kept, head_bytes, slot_bytes, shard_keys), "div-counts")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    # Numbers by rank: a window a language, over its sources and not their rows; the pairs are as many as their squares.
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(groups.withColumns({"no": number.cast("int"), "plain": _share(F.lit(0), F.col("total"), F.col("terms"), scale)}), "div-groups")
    shares = counts.join(groups.select("lang", "source", "no", "total", "terms"), ["lang", "source"])
    shares = materialize(shares.select("lang", "source", "no", "term", "terms", _share(F.col("n"), F.col("total"), F.col("terms"), scale).alias("p")), "div-shares")

    names = groups.select("lang", "no", "source")
    pairs = pair_values(shares.select("lang", "no", "term", "p"), groups, tile, term_shards)
    pairs = pairs.join(names.select("lang", F.col("no").alias("s"), "source"), ["lang", "s"]).join(
        names.select("lang", F.col("no").alias("t"), F.col("source").alias("item")), ["lang", "t"])
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ordered).alias("rank"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    common = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang")
    common = common.select("lang", "term", _share(F.col("n"), F.col("total"), F.col("terms"), scale).alias("q"))
    more = shares.join(common, ["lang", "term"]).filter("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    best = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ordered))
    found = pairs.unionByName(best.filter(F.col("rank") <= top))
    return found.select(*[F.col(c).cast("string").alias(c) if c in ("lang", "source", "item") else F.col(c) for c in ("lang", "source", "part", "item", "value", "rank")])
