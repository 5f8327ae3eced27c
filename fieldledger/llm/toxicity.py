"""Toxicity scores by weak supervision.

Voters: a lexicon voter fires on texts in which some word begins with its 2 to 8 bytes (or is its whole word of up to 7);
the lexicon is what stands out in toxic texts of the training labels, by likelihood ratio (of nested beginnings, the shortest that says as much). Pattern voters look at form
(shouting, marks in a row, masked letters, digits, address forms) and vote toxic or clean as they lean on the training
labels. A generative label model estimates how often each voter fires on toxic and on clean texts (EM from
the training labels on) and how voters correlate given the class; correlated voters share their weight. A linear classifier is trained on the model's posteriors, over the counts of all voters. Every text is scored
whole by the classifier alone.

Only rows with crc32(doc_id as text) mod 5 <> 0 teach: `fit_rows` of them, lowest by a hash of the id (the bound of what
the driver sees: fit_rows x voters counts). Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts get the score of a text on which no voter fires. Without any usable label, every score is 0. Several
labels of one id: toxic if any says so; null labels do not count. Null ids are scored, not held out, and never teach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import _MASK, WORD_BREAK, Words, portions, saved

FIT_ROWS = 20_000
VOTERS = 300
PORTION = 1 << 19  #: bytes of text for which counts are held at once
#: Fixed: form patterns, counted per text (over the folded words but for the first two).
PATTERNS = ("shouted words", "shouted share", "exclamations", "marks in a row", "masked letters", "digits", "addresses", "second person", "long words", "few words")
_SECOND = [b"you", b"your", b"du", b"dein", b"ihr", b"tu", b"toi", b"vous", b"usted", b"te"]


def _eights(w: Words) -> tuple[np.ndarray, np.ndarray]:
    size = w.end - w.start
    view = np.lib.stride_tricks.as_strided(w.bytes[:8].view(np.uint64), (len(w.bytes) - 7,), (1,), writeable=False)
    return view[w.start] & _MASK[np.minimum(size, 8)], size


def _beginnings(first: np.ndarray, size: np.ndarray):
    """(place in the words, key) for the beginnings of 3 to 8 bytes and the whole words of up to 7.

    A key is the bytes themselves; a whole word ends with a space, so no key stands for two things."""
    for k in range(3, 9):
        at = np.flatnonzero(size >= k)
        yield at, first[at] & _MASK[k]
    at = np.flatnonzero(size <= 7)
    yield at, first[at] | (np.uint64(0x20) << (8 * size[at]).astype(np.uint64))


def _forms(column, w: Words) -> np.ndarray:
    """Pattern counts of each text."""
    raw = Words(column)
    n = len(column)
    count = np.maximum(w.count, 1)
    out = np.zeros((n, len(PATTERNS)))
    per = lambda mask, doc: np.bincount(doc[mask], minlength=n)
    letters = raw.bytes[:-8]
    upper = np.concatenate([[0], np.cumsum((letters >= 65) & (letters <= 90))])
    size = raw.end - raw.start
    shout = (size >= 3) & (upper[raw.end] - upper[raw.start] == size)
    out[:, 0] = per(shout, raw.doc)
    out[:, 1] = (upper[raw.offsets[1:]] - upper[raw.offsets[:-1]]) / np.maximum(np.diff(raw.offsets), 1)
    marks = np.concatenate([[0], np.cumsum(letters == 33)])
    out[:, 2] = marks[raw.offsets[1:]] - marks[raw.offsets[:-1]]
    sign = (letters > 32) & (letters < 48)
    row = np.concatenate([[0], np.cumsum(np.concatenate([[False, False], sign[2:] & sign[1:-1] & sign[:-2]]) if len(sign) > 2 else np.zeros(len(sign), bool))])
    out[:, 3] = row[raw.offsets[1:]] - row[raw.offsets[:-1]]
    star = np.concatenate([[0], np.cumsum(letters == 42)])
    inside = (size >= 3) & (star[np.maximum(raw.end - 1, raw.start)] - star[np.minimum(raw.start + 1, raw.end)] > 0)
    out[:, 4] = per(inside, raw.doc)
    digit = np.concatenate([[0], np.cumsum((letters >= 48) & (letters <= 57))])
    out[:, 5] = digit[raw.offsets[1:]] - digit[raw.offsets[:-1]]
    at = np.concatenate([[0], np.cumsum(letters == 64)])
    out[:, 6] = at[raw.offsets[1:]] - at[raw.offsets[:-1]]
    first, size = _eights(w)
    second = np.array([int.from_bytes(x, "little") for x in _SECOND], dtype=np.uint64)
    out[:, 7] = per((size <= 5) & np.isin(first, second), w.doc)
    out[:, 8] = per(size >= 20, w.doc)
    out[:, 9] = w.count < 10
    out[:, [0, 2, 3, 4, 5, 6, 7, 8]] /= np.sqrt(count)[:, None]
    return out


def _counts(column, lexicon: np.ndarray) -> np.ndarray:
    """Texts x (lexicon + patterns)."""
    w = Words(column, fold=True)
    first, size = _eights(w)
    n, m = len(column), len(lexicon)
    out = np.zeros(n * m)
    if m:
        for at, key in _beginnings(first, size):
            k = np.minimum(np.searchsorted(lexicon, key), m - 1)
            hit = lexicon[k] == key
            out += np.bincount(w.doc[at[hit]] * m + k[hit], minlength=n * m)
    return np.concatenate([out.reshape(n, m), _forms(column, w)], axis=1)


def _training(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    each = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # at most fit_rows rows: a proven bound
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    # copies would pass their chance words off as a lexicon: of texts with the same three least word hashes, one teaches
    sketch = F.slice(F.sort_array(F.transform(F.array_distinct(F.split(F.lower("text"), WORD_BREAK)), lambda w: F.xxhash64(w))), 1, 3)
    return saved(rows.groupBy(sketch.alias("_sketch")).agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("r")).select("r.text", "r.toxic"), "labelled")


def _lexicon(rows: DataFrame, toxic: int, clean: int, voters: int) -> np.ndarray:
    """Keys that stand out in toxic texts, sorted."""

    def tally(batches):
        for batch in portions(batches, size=PORTION):  # some 15 keys of 8 bytes stand for a word while they are sorted
            w = Words(batch.column("text"), fold=True)
            first, size = _eights(w)
            label = np.asarray(batch.column("toxic"))
            doc, keys = (np.concatenate(x) for x in zip(*((w.doc[at], key) for at, key in _beginnings(first, size)), strict=True))
            order = np.lexsort((doc, keys))
            doc, keys = doc[order], keys[order]
            new = np.append([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))[: len(keys)]
            u, which = np.unique(keys[new], return_inverse=True)
            bad = np.bincount(which, weights=label[doc[new]], minlength=len(u))
            yield pa.RecordBatch.from_pydict({"key": pa.array(u.view(np.int64)), "bad": pa.array(bad.astype(np.int64)), "good": pa.array((np.bincount(which, minlength=len(u)) - bad).astype(np.int64))})

    seen = rows.mapInArrow(tally, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    # a word three times as frequent in toxic texts would have this share of them; evidence (in nats) that it has more
    three = 3 * toxic / (3 * toxic + clean)
    n = F.col("bad") + F.col("good")
    proof = F.col("bad") * F.log(F.col("bad") / (n * three)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - three)))).otherwise(0.0)
    ranked = seen.where(F.col("bad") > 0).withColumn("lift", lift).where((F.col("bad") > three * n) & (proof >= 14)).withColumn("gain", F.col("bad") * F.log("lift"))  # 14: many are tried
    best = ranked.orderBy(F.col("gain").desc(), "key").limit(8 * voters).collect()
    held = {(r["key"] % (1 << 64)).to_bytes(8, "little").rstrip(b"\0"): r for r in best}
    # a beginning gives way to longer ones that say much more and have most of its toxic texts ...
    told: dict[bytes, int] = {}
    for word, r in held.items():
        if word[:-1] in held and r["lift"] >= 2 * held[word[:-1]]["lift"]:
            told[word[:-1]] = told.get(word[:-1], 0) + r["bad"]
    kept: dict[bytes, float] = {}
    for word in sorted(held, key=len):
        shorter = max((kept[word[:k]] for k in range(2, len(word)) if word[:k] in kept), default=0)
        # ... and a longer one to a beginning that says about as much
        if told.get(word, 0) < 0.7 * held[word]["bad"] and 2 * shorter < held[word]["lift"]:
            kept[word] = held[word]["lift"]
    chosen = sorted(kept, key=lambda w: (-held[w]["gain"], w))[:voters]
    return np.sort(np.array([int.from_bytes(w, "little") for w in chosen], dtype=np.uint64))


def label_model(fires: np.ndarray, lean: np.ndarray, label: np.ndarray, turns: int = 25) -> np.ndarray:
    """Posterior of the toxic class for each text.

    fires: texts x voters (0/1); lean: +1 votes toxic, -1 votes clean; a voter that does not fire abstains. The model
    starts from the training labels, then accuracies come from agreement among the voters (EM), held to the labels with
    the weight of as many texts again, as labels are noisy; correlations given the class lower the weight of voters that
    say the same."""
    prior = (label.sum() + 0.5) / (len(label) + 1)
    said_a, said_b = label @ fires, (1 - label) @ fires
    q, weight = np.where(label > 0, 0.95, 0.02), np.ones(fires.shape[1])
    for turn in range(turns):
        a = (q @ fires + said_a + 0.1) / (q.sum() + label.sum() + 0.2)
        b = ((1 - q) @ fires + said_b + 0.1) / ((1 - q).sum() + (1 - label).sum() + 0.2)
        # a voter never counts against the side it votes for
        a, b = np.where((lean > 0) & (a < b), b, a), np.where((lean < 0) & (b < a), a, b)
        if turn in (1, 8, 16):
            expected = q[:, None] * a + (1 - q)[:, None] * b
            rest = (fires - expected) / np.sqrt(np.maximum(expected * (1 - expected), 1e-4))
            corr = rest.T @ rest / len(fires)
            scale = np.sqrt(np.maximum(np.diag(corr), 1e-9))
            corr = np.clip(corr / scale / scale[:, None], 0, 1)
            corr[corr < 0.3] = 0  # voters of one language always go together a little
            weight = 1 / np.maximum(corr.sum(axis=0), 1)
        z = np.log(prior / (1 - prior)) + fires @ (np.log(a / b) * weight)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def _linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.02, turns: int = 25) -> np.ndarray:
    """Weights (last: constant) of a logistic classifier on soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (q - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _inputs(counts: np.ndarray, m: int) -> np.ndarray:
    """What the classifier sees: which words fired, whether any did, and the form."""
    fired = (counts[:, :m] > 0).astype(float)
    return np.concatenate([fired, np.minimum(counts[:, m:], 3), fired.max(axis=1, keepdims=True, initial=0)], axis=1)


class Model:
    def __init__(self, lexicon: np.ndarray, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, column) -> np.ndarray:
        z = _inputs(_counts(column, self.lexicon), len(self.lexicon)) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, voters: int = VOTERS) -> Model | None:
    rows = _training(docs, labels, fit_rows)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return None
    lexicon = _lexicon(rows, toxic, clean, voters)

    def read(batches):
        for batch in portions(batches, size=PORTION):
            c = _counts(batch.column("text"), lexicon).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"c": pa.array([r.tobytes() for r in c], pa.binary()), "toxic": batch.column("toxic")})

    seen = rows.mapInArrow(read, "c binary, toxic int").toPandas()  # fit_rows x voters numbers at most
    m = len(lexicon)
    counts = np.frombuffer(b"".join(seen["c"]), np.float32).reshape(len(seen), -1).astype(float)
    label = seen["toxic"].to_numpy()
    # a pattern votes where it is above the level of most clean texts; its side is where it leans on the labels
    level = np.quantile(counts[label == 0][:, m:], 0.95, axis=0)
    form = counts[:, m:] > np.maximum(level, 1e-9)
    rates = [(form[label == k].sum(axis=0) + 0.5) / ((label == k).sum() + 1) for k in (1, 0)]
    silent = ~(counts[:, :m] > 0).any(axis=1, keepdims=True)  # one more voter: no word of the lexicon, so clean
    lean = np.concatenate([np.ones(m), np.where(rates[0] >= rates[1], 1, -1), [-1]])
    q = label_model(np.concatenate([counts[:, :m] > 0, form, silent], axis=1).astype(float), lean, label.astype(float))
    return Model(lexicon, _linear(_inputs(counts, m), q))


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, voters: int = VOTERS) -> DataFrame:
    """All columns of `docs` and score (a column of that name is replaced)."""
    docs = docs.drop("score")
    model = fit(docs, labels, fit_rows, voters)
    if model is None:
        return docs.withColumn("score", F.lit(0.0))

    def work(batches):
        for batch in batches:
            for part in portions([batch], size=PORTION):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column("text").fill_null("")), pa.float64())], names=[*part.schema.names, "score"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{columns}, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), labels)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
