"""Collocations from counts held in weighted acyclic automata.

Shards. Texts of one language are cut into shards of bounded size; a shard is its words with their counts and its texts
as places in that list (0 between pieces). Word buckets add up the shards' counts; words of `least` or more occurrences
get a number, which goes back to the shards; all others end a run, since no phrase with a rarer word can reach `least`.

Transducers. A shard's runs give sorted n-grams of 1 to 5 words, and from these its count transducer is built level by
level: a deterministic acyclic automaton over word numbers whose arc, read as the last word of an n-gram, outputs how
often that n-gram occurs. Common prefixes are shared; tails are not, as their weights differ. It is kept in level form:
labels, weights and numbers of children in sorted order.

Union. The space of n-grams is cut at sampled five-word points, so that a frequent first word is cut as well. Each range
gets every shard's arcs of that range; an n-gram counts where its own words fall, and arcs kept only to reach longer ones
weigh 0. A range sums equal arcs level by level and follows only those that reach `least` (or only lead on), which loses
nothing: no phrase is more frequent than its beginning.

Parts. A range asks for the counts of all parts of its phrases; the ranges where these fall run the sorted parts through their own
transducer (a composition of two acyclic automata) and answer. Scores are made of 38-digit decimals. Words are joined back last.

Bounds: a shard holds `shard_bytes` of text, or one longer text; a bucket about `bucket_words` words of shards; a range about `range_words` word occurrences in as many
entries at most; the driver and each task hold the cut points, one for each range.

Odd rows. A null or empty text has no words, a null language is `und`. Repeated rows count each. Ties end with the phrase in byte order,
which is unique. Empty tables, and languages without a candidate, give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import Words, pieces, portions, saved
from fieldledger.llm.keyed import lists

#: Longest phrase; fewest occurrences; UTF-8 bytes of text in a shard; word occurrences of a range.
LONGEST, LEAST, SHARD_BYTES, RANGE_WORDS = 5, 100, 6 << 20, 4_000_000
#: Words of shards in a bucket; bytes of text a task holds in shards that are not full.
BUCKET_WORDS, HELD_BYTES = 400_000, 24 << 20
#: Cut points are taken from so many sampled phrases for each range, and so many from one shard.
SAMPLED, SAMPLED_IN_SHARD = 32, 64

#: Bytes that end a piece: `.,;:!?` and line breaks. All become a line feed before words are read.
_PIECE_END = np.arange(256, dtype=np.uint8)
_PIECE_END[list(b".,;:!?\x0b\x0c\x0d")] = 0x0A


# -- numbers in bytes ---------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - (w == 8)))
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


# -- shards ---------------------------------------------------------------------------------------------------------------


def _pieced(column: pa.Array) -> pa.Array:
    """The texts with every byte that ends a piece as a line feed."""
    arr = column.fill_null("").cast(pa.large_string())
    raw = arr.buffers()[2]
    data = _PIECE_END[np.frombuffer(raw, np.uint8)] if raw is not None and raw.size else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(arr), [None, arr.buffers()[1], pa.py_buffer(data)], offset=arr.offset)


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each distinct word, and each word's place among them. Hashes are checked against the bytes."""
    size = w.end - w.start
    salt = 0
    while True:
        _, first, place = np.unique(w.hashes(salt), return_index=True, return_inverse=True)
        like, at, k, same = first[place], np.arange(len(size)), 0, True
        if (size != size[like]).any():
            same = False
        while same and len(at):
            for j in range(8):  # bytes k + j of all words that have them
                has = at[size[at] > k + j]
                if (w.bytes[w.start[has] + k + j] != w.bytes[w.start[like[has]] + k + j]).any():
                    same = False
                    break
            k += 8
            at = at[size[at] > k]
        if same:
            return first, place
        salt += 1


def _shard(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their hashes and counts, and the texts as places from 1 on with 0 at the end of each piece."""
    w = Words(_pieced(texts), fold=True)
    if not len(w.start):
        return [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first, place = _distinct(w)
    ends = np.concatenate([[0], np.cumsum(w.bytes == 0x0A)])
    cut = np.append((ends[w.start[1:]] > ends[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1]), True)
    out = np.zeros(len(place) + int(cut.sum()), np.int64)
    out[np.arange(len(place)) + np.cumsum(cut) - cut] = place + 1
    return [w.text(i) for i in first], w.hashes()[first].view(np.int64), np.bincount(place, minlength=len(first)), out


def _shards(docs: DataFrame, size: int) -> DataFrame:
    def work(batches):
        from pyspark import TaskContext

        part, k, held, room = TaskContext.get().partitionId(), 0, {}, {}

        def row(lang):
            nonlocal k
            texts = pa.concat_arrays(held.pop(lang))
            room.pop(lang)
            words, hashes, counts, places = _shard(texts)
            if words:
                k += 1
                flat = pa.array(words, pa.binary()).cast(pa.string())
                whole = np.array([len(words)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{k}"]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), flat), lists(hashes, whole), lists(counts, whole), pa.array([pack(places)], pa.binary())],
                    names=["shard", "lang", "words", "hashes", "counts", "places"],
                )

        for b in portions(batches, size=size // 4):
            langs = b.column("lang")
            for lang in sorted(pc.unique(langs).to_pylist()):
                own = b.column("text").filter(pc.equal(langs, lang)).fill_null("").cast(pa.large_string())
                if lang in held and room[lang] + own.nbytes > size:
                    yield from row(lang)
                held.setdefault(lang, []).append(own)
                room[lang] = room.get(lang, 0) + own.nbytes
            while sum(room.values()) > HELD_BYTES:
                yield from row(max(room, key=room.get))
        for lang in sorted(held):
            yield from row(lang)

    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return docs.mapInArrow(work, "shard string, lang string, words array<string>, hashes array<long>, counts array<long>, places binary")


def _dealt(batches, buckets: int):
    """A shard's words to their buckets, a row for each."""
    for b in batches:
        for i, shard in enumerate(b.column("shard").to_pylist()):
            hashes, counts = (np.asarray(b.column(n)[i].values) for n in ("hashes", "counts"))
            bucket = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            there, first = np.unique(bucket[order], return_index=True)
            ends = np.append(first[1:], len(order)).astype(np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), b.column("words")[i].values.take(pa.array(order)))
            same = lambda value: pa.array([value] * len(there))  # noqa: B023,E731 - used at once
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), same(shard), same(b.column("lang")[i].as_py()), words, lists(counts[order], ends), lists(order, ends)], names=["bucket", "shard", "lang", "words", "counts", "pos"])


_COUNTED = "shard string, pos array<long>, id array<long>, langs array<string>, words array<string>, f array<long>"


def _counted(bucket: int, rows: pa.Table, buckets: int, least: int) -> pa.Table:
    """A bucket's frequent words with their numbers (a row without shard), and for each shard the numbers of its words."""
    chunked = rows.column("words").combine_chunks()
    word = chunked.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(chunked)), np.asarray(chunked.value_lengths()))
    langs = pa.array(rows.column("lang").to_pylist()).dictionary_encode()
    lang = np.asarray(langs.indices)[row].astype(np.int64)
    pairs, place = np.unique(np.asarray(word.indices).astype(np.int64) * len(langs.dictionary) + lang, return_inverse=True)
    f = np.zeros(len(pairs), np.int64)
    np.add.at(f, place, np.asarray(rows.column("counts").combine_chunks().flatten()))
    often = f >= least
    number = np.where(often, 1 + bucket + buckets * (np.cumsum(often) - 1), 0)
    kept = pairs[often]
    n = np.array([len(kept)])
    ids = number[place]
    told = ids > 0
    ends = np.cumsum(np.bincount(row[told], minlength=len(chunked)))
    shards = pa.table(
        {
            "shard": pa.array([None, *rows.column("shard").to_pylist()], pa.string()),
            "pos": lists(np.asarray(rows.column("pos").combine_chunks().flatten())[told], np.append(0, ends)),
            "id": lists(np.concatenate([number[often], ids[told]]), np.append(n, n + ends)),
        }
    )
    texts = lambda values: pa.ListArray.from_arrays(pa.array([0] + [len(values)] * (len(chunked) + 1), pa.int32()), values.cast(pa.string()))
    return shards.append_column("langs", texts(langs.dictionary.take(pa.array(kept % len(langs.dictionary))))).append_column("words", texts(word.dictionary.take(pa.array(kept // len(langs.dictionary))))).append_column("f", lists(f[often], np.full(len(chunked) + 1, n[0])))


def _encoded(places: pa.Table, known: pa.Table, longest: int) -> pa.Table:
    """A shard's texts as word numbers, and some of its phrases for the cut points."""
    names = {"ids": pa.binary(), "sample": pa.list_(pa.list_(pa.int64()))}
    if not places.num_rows or not known.num_rows:
        return pa.table({n: pa.array([], t) for n, t in names.items()})
    at = unpack(places.column("places")[0].as_py())
    number = np.zeros(int(at.max()) + 1, np.int64)
    number[np.asarray(known.column("pos").combine_chunks().flatten()) + 1] = np.asarray(known.column("id").combine_chunks().flatten())
    ids = number[at]
    ids = ids[(ids > 0) | np.concatenate([[False], ids[:-1] > 0])]  # one 0 after each run
    starts = np.flatnonzero(ids)
    if not len(starts):  # no word here is frequent
        return pa.table({n: pa.array([], t) for n, t in names.items()})
    wide = np.concatenate([ids, np.zeros(longest, np.int64)])
    pick = starts[np.unique(np.linspace(0, len(starts) - 1, SAMPLED_IN_SHARD).astype(int))]
    tuples = wide[pick[:, None] + np.arange(longest)]
    tuples[np.cumsum(tuples == 0, axis=1) > 0] = 0
    return pa.table({"ids": pa.array([pack(ids)], pa.binary()), "sample": pa.array([tuples.tolist()], names["sample"])})


# -- transducers ------------------------------------------------------------------------------------------------------------


class Transducer:
    """Levels 1 to `longest`; arcs of a level are sorted by (parent, label). Keys are parent * base + label."""

    def __init__(self, labels: list[np.ndarray], weights: list[np.ndarray], parents: list[np.ndarray]):
        self.labels, self.weights, self.parents = labels, weights, parents
        self.base = 1 + max((int(x.max()) for x in labels if len(x)), default=0)
        self.keys = [p * self.base + x for p, x in zip(parents, labels, strict=True)]

    @classmethod
    def of_runs(cls, ids: np.ndarray, longest: int) -> Transducer:
        """Counts of all n-grams inside the runs between zeros. Each level extends the sorted n-grams of the one before."""
        numbers, rank = np.unique(ids, return_inverse=True)
        base = len(numbers)
        at, node = np.flatnonzero(ids), None
        labels, weights, parents = [], [], []
        for k in range(longest):
            if k:
                go = at + k < len(ids)
                at, node = at[go], node[go]
                go = ids[at + k] > 0
                at, node = at[go], node[go]
            key = rank[at + k] if node is None else node * base + rank[at + k]
            arcs, node, count = np.unique(key, return_inverse=True, return_counts=True)
            labels.append(numbers[arcs % base])
            weights.append(count.astype(np.int64))
            parents.append(arcs // base if k else np.zeros(len(arcs), np.int64))
        return cls(labels, weights, parents)

    def below(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For rows of word numbers (0 after the last), at each level: how many arcs come before the row's beginning of
        that length, and whether the next arc is that beginning."""
        out, low, same = [], np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for k in range(len(self.labels)):
            label = np.minimum(points[:, k], self.base)
            low = np.searchsorted(self.keys[k], np.where(same, low * self.base + label, low * self.base))
            if len(self.keys[k]):
                i = np.minimum(low, len(self.keys[k]) - 1)
                same = same & (label > 0) & (label < self.base) & (low < len(self.keys[k])) & (self.keys[k][i] == self._prior(out, k, len(points)) * self.base + label)
            else:
                same = np.zeros(len(points), bool)
            out.append((low, same))
        return out

    @staticmethod
    def _prior(out: list, k: int, n: int) -> np.ndarray:
        return out[k - 1][0] if k else np.zeros(n, np.int64)

    def ranges(self, cuts: np.ndarray):
        """(range, packed levels) of all ranges this transducer has arcs in."""
        longest = len(self.labels)
        edge = []
        for k, (low, same) in enumerate(self.below(cuts)):
            more = (cuts[:, k + 1 :] > 0).any(1) if k + 1 < longest else np.zeros(len(cuts), bool)
            edge.append(np.concatenate([[0], low + (same & more), [len(self.labels[k])]]))
        for r in range(len(cuts) + 1):
            own = [(int(e[r]), int(e[r + 1])) for e in edge]
            need = list(own)
            for k in range(longest - 2, -1, -1):
                a, b = need[k + 1]
                if b > a:
                    p, q = int(self.parents[k + 1][a]), int(self.parents[k + 1][b - 1]) + 1
                    x, y = need[k]
                    need[k] = (min(x, p), max(y, q)) if y > x else (p, q)
            if not any(b > a for a, b in own):
                continue
            levels = []
            for k, (a, b) in enumerate(need):
                weights = self.weights[k][a:b].copy()
                x, y = own[k]
                inside = np.arange(a, b)
                weights[(inside < x) | (inside >= y)] = 0
                c, d = need[k + 1] if k + 1 < longest else (0, 0)
                children = np.bincount(self.parents[k + 1][c:d] - a, minlength=b - a) if d > c else np.zeros(b - a, np.int64)
                levels += [pack(self.labels[k][a:b]), pack(weights), pack(children)]
            yield r, levels

    @classmethod
    def union(cls, packed: list[list[bytes]], longest: int, least: int) -> Transducer:
        """Sums of equal arcs, of those that reach `least` or lead on to arcs of this range."""
        labels, weights, parents, group = [], [], [], None
        for k in range(longest):
            label, weight, children = (np.concatenate([unpack(p[3 * k + i]) for p in packed]) for i in range(3))
            base = int(label.max()) + 1 if len(label) else 1
            live = np.arange(len(label)) if group is None else np.flatnonzero(group >= 0)
            key = label[live] + (0 if group is None else group[live] * base)
            arcs, inverse = np.unique(key, return_inverse=True)
            total = np.zeros(len(arcs), np.int64)
            np.add.at(total, inverse, weight[live])
            stays = (total >= least) | (total == 0)
            number = np.where(stays, np.cumsum(stays) - 1, -1)
            arcs = arcs[stays]
            labels.append(arcs % base)
            parents.append(arcs // base)
            weights.append(total[stays])
            here = np.full(len(label), -1, np.int64)
            here[live] = number[inverse] if len(inverse) else -1
            group = np.repeat(here, children)
        return cls(labels, weights, parents)

    def packed(self) -> list[bytes]:
        return [pack(x) for level in zip(self.labels, self.weights, self.parents, strict=True) for x in level]

    @classmethod
    def unpacked(cls, data: list[bytes]) -> Transducer:
        levels = [unpack(x) for x in data]
        return cls(levels[0::3], levels[1::3], levels[2::3])

    def phrases(self, k: int) -> np.ndarray:
        """Word numbers of all arcs of level k (from 0), 0 after the last word."""
        longest = len(self.labels)
        out = np.zeros((len(self.labels[k]), longest), np.int64)
        at = np.arange(len(out))
        for j in range(k, -1, -1):
            out[:, j] = self.labels[j][at]
            at = self.parents[j][at]
        return out

    def read(self, parts: np.ndarray) -> np.ndarray:
        """Composition with an acceptor of phrases: the weight of each row's phrase, 0 if it is not there."""
        out = np.zeros(len(parts), np.int64)
        size = (parts > 0).sum(1)
        for k, (low, same) in enumerate(self.below(parts)):
            ends = np.flatnonzero(same & (size == k + 1))
            out[ends] = self.weights[k][low[ends]]
        return out


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel() if len(rows) else np.empty(0, f"S{8 * rows.shape[1]}")


def range_of(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_as_bytes(cuts), _as_bytes(rows), "right") if len(cuts) else np.zeros(len(rows), np.int64)


def _parts(t: Transducer) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from two words on: phrases that count here, and their weights."""
    out = []
    for k in range(1, len(t.labels)):
        own = np.flatnonzero(t.weights[k])
        out.append((t.phrases(k)[own], t.weights[k][own]))
    return out


def _cuts_of(phrases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First parts and rests of phrases after their first k words."""
    first, rest = phrases.copy(), np.zeros_like(phrases)
    first[:, k:] = 0
    rest[:, : phrases.shape[1] - k] = phrases[:, k:]
    return first, rest


def _distinct_rows(rows: np.ndarray) -> np.ndarray:
    return rows[np.unique(_as_bytes(rows), return_index=True)[1]] if len(rows) else rows


def _rows_packed(rows: np.ndarray) -> list[bytes]:
    return [pack(rows[:, j]) for j in range(rows.shape[1])]


def _rows_unpacked(data: list[bytes]) -> np.ndarray:
    return np.stack([unpack(x) for x in data], axis=1)


def _asked(t: Transducer, own: int, cuts: np.ndarray) -> pa.Table:
    parts = [p for phrases, _ in _parts(t) for k in range(1, len(t.labels)) for p in _cuts_of(phrases[phrases[:, k] > 0], k)]
    parts = _distinct_rows(np.concatenate(parts))
    to = range_of(parts, cuts)
    there = np.unique(to)
    return pa.table({"range": pa.array(there.astype(np.int32)), "asker": pa.array(np.full(len(there), own), pa.int32()), "parts": pa.array([_rows_packed(parts[to == r]) for r in there.tolist()], pa.list_(pa.binary()))})


def _answered(t: Transducer, asks: pa.Table) -> pa.Table:
    parts = asks.column("parts").to_pylist()
    return pa.table({"asker": asks.column("asker"), "parts": pa.array(parts, pa.list_(pa.binary())), "f": pa.array([pack(t.read(_rows_unpacked(p))) for p in parts], pa.binary())})


def _with_parts(t: Transducer, told: pa.Table) -> pa.Table:
    """path, a, and for each cut the counts of its two parts."""
    rows = np.concatenate([_rows_unpacked(p) for p in told.column("parts").to_pylist()])
    f = np.concatenate([unpack(x) for x in told.column("f").to_pylist()])
    names = _as_bytes(rows)
    order = np.argsort(names)
    names, f = names[order], f[order]
    count = lambda part: f[np.searchsorted(names, _as_bytes(part))]
    tables = []
    for k, (phrases, a) in enumerate(_parts(t), 2):
        sides = [[count(x) for x in _cuts_of(phrases, j)] for j in range(1, k)]
        ends = np.arange(1, len(a) + 1)
        flat = [np.stack([s[i] for s in sides], axis=1).ravel() for i in range(2)] if len(a) else [np.empty(0, np.int64)] * 2
        tables.append(pa.table({"path": lists(phrases[:, :k].ravel(), ends * k), "a": pa.array(a), "l": lists(flat[0], ends * (k - 1)), "r": lists(flat[1], ends * (k - 1))}))
    return pa.concat_tables(tables)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(phrases: path, a, l, r), (words: lang, word, f, id), (totals: lang, n); None if no word is frequent enough."""
    shards = saved(_shards(docs, shard_bytes), "shards")
    totals = saved(shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = pieces(shards.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0], bucket_words)
    dealt = shards.select("shard", "lang", "words", "hashes", "counts").mapInArrow(lambda batches: _dealt(batches, buckets), "bucket int, shard string, lang string, words array<string>, counts array<long>, pos array<long>")
    counted = saved(dealt.groupBy("bucket").applyInArrow(lambda key, rows: _counted(key[0].as_py(), rows, buckets, least), _COUNTED), "words")
    frequent = counted.where("shard is null").select(F.explode(F.arrays_zip("langs", "words", "f", "id")).alias("e")).select(F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.f").alias("f"), F.col("e.id").alias("id"))
    sums = frequent.agg(F.sum("f")).first()[0]
    if not sums:
        return None
    known = counted.where("shard is not null").select("shard", "pos", "id")
    places = shards.select(F.col("shard").alias("shard"), "places")
    texts = saved(places.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lambda p, w: _encoded(p, w, longest), "ids binary, sample array<array<long>>"), "texts")
    ranges = pieces(sums, range_words)
    points = texts.select(F.explode("sample").alias("p")).distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLED * ranges).collect() if ranges > 1 else []  # a bounded number for each range
    points = sorted(tuple(r["p"]) for r in points)
    cuts = np.array(sorted({points[i * len(points) // ranges] for i in range(1, ranges)}) if points else [], np.int64).reshape(-1, longest)

    def build(batches):
        for b in batches:
            for ids in b.column("ids").to_pylist():
                rows = list(Transducer.of_runs(unpack(ids), longest).ranges(cuts))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.binary()))], names=["range", "levels"])

    def union(key, rows):
        t = Transducer.union(rows.column("levels").to_pylist(), longest, least)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([t.packed()], pa.list_(pa.binary()))})

    kinds = "range int, levels array<binary>"
    summed = saved(texts.select("ids").mapInArrow(build, kinds).groupBy("range").applyInArrow(union, kinds), "transducers")

    def ask(batches):
        for b in batches:
            for r, levels in zip(b.column("range").to_pylist(), b.column("levels").to_pylist(), strict=True):
                yield from _asked(Transducer.unpacked(levels), r, cuts).to_batches()

    def with_one(fn, empty: pa.Table):
        def work(own, other):
            return fn(Transducer.unpacked(own.column("levels")[0].as_py()), other) if own.num_rows and other.num_rows else empty

        return work

    asks = summed.mapInArrow(ask, "range int, asker int, parts array<binary>")
    none = pa.table({"asker": pa.array([], pa.int32()), "parts": pa.array([], pa.list_(pa.binary())), "f": pa.array([], pa.binary())})
    told = summed.groupBy("range").cogroup(asks.groupBy("range")).applyInArrow(with_one(_answered, none), "asker int, parts array<binary>, f binary")
    nothing = pa.table({"path": pa.array([], pa.list_(pa.int64())), "a": pa.array([], pa.int64()), "l": pa.array([], pa.list_(pa.int64())), "r": pa.array([], pa.list_(pa.int64()))})
    again = summed.select(F.col("range").alias("range"), F.col("levels").alias("levels"))
    phrases = again.groupBy("range").cogroup(told.groupBy("asker")).applyInArrow(with_one(_with_parts, nothing), "path array<long>, a long, l array<long>, r array<long>")
    return saved(phrases, "phrases"), frequent, totals


def collocations(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    found = phrase_counts(docs, **options)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases, words, totals = found
    size = F.size("path")
    inner = phrases.where(size > 2).select(
        F.filter(F.array(F.when(F.element_at("l", -1) == F.col("a"), F.slice("path", F.lit(1), size - 1)), F.when(F.element_at("r", 1) == F.col("a"), F.slice("path", F.lit(2), size - 1))), lambda x: x.isNotNull()).alias("in")
    )
    held = inner.select(F.explode("in").alias("path")).distinct()  # phrases that a phrase one word longer always contains
    left = phrases.join(held, "path", "left_anti").withColumn("id", F.col("path")[0]).join(words.select("id", "lang"), "id").join(totals, "lang")
    long = lambda c: c.cast("decimal(19,0)")
    above = F.lit(1000).cast("decimal(4,0)") * long(F.col("a")) * long(F.col("n"))
    cut = F.transform(F.sequence(F.lit(0), size - 2), lambda k: F.struct(F.call_function("div", above, long(F.get("l", k)) * long(F.get("r", k))).alias("score"), k.alias("k"), F.get("l", k).alias("l"), F.get("r", k).alias("r")))
    scored = left.withColumn("cut", F.array_min(cut)).select("path", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a")]
    near = saved(scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place"), "near")
    named = near.select("path", F.posexplode("path").alias("pos", "id")).join(words.select("id", "word"), "id")
    named = named.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # at most `longest` words
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return near.join(named, "path").withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
