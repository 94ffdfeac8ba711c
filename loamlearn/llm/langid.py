"""Language identification by error-correcting output codes over binary n-gram classifiers.

Each language has a codeword; bit b of all codewords splits the languages in two, and a classifier
of hashed byte n-grams (naive Bayes log-odds of the two sides) predicts that bit. The language whose
codeword has the least logistic loss against the predicted margins is chosen.

Losses of codewords differ by half the sum of margins times codes, so a text's gap is the sum of the
gaps of its runs of ``RUN`` bytes. Each run is evidence for its own best language, as much as its gap
to the second, at most ``RUN_GAP``; ``score`` is the share of this evidence that speaks for the chosen
language. It doesn't grow with the length of the text: one language gives nearly 1, half of another
about a half. A share under ``AMBIGUOUS_SHARE`` makes the text ambiguous, as does hardly any evidence
at all (``AMBIGUOUS_GAP``).

Classifiers are fitted on a bounded sample: about ``sample_docs`` distinct texts of each language,
chosen by a hash. Statistics come to the driver as one count vector of fixed length a language.

Defined cases: null text and text without a letter are ``und`` with score 0; without any labelled
text every prediction is ``und``; a single learned language has score 1; repeated rows are predicted
each; long texts are read in slices, to the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

ORDERS, BUCKET_BITS = (2, 3, 4), 14
DIM = len(ORDERS) << BUCKET_BITS
#: Bytes read at once, and the n-gram's share of the evidence: overlapping n-grams repeat each other.
SLICE, EVIDENCE = 1 << 18, 0.25
#: Rows predicted at once.
ROWS = 512
#: Bytes of a run, a divisor of SLICE, and its greatest gap: telling letters don't outweigh the rest of a text.
RUN, RUN_GAP = 8, 20.0
#: A share of evidence, or a gap of all losses, under this marks the text as ambiguous: over a third in other
#: languages. Of 1,200 halves of labelled texts of sf0.1 that were not learned 97 in 100 or more are under it, of the
#: 2,499 texts themselves two, which hold passages in another language.
AMBIGUOUS_SHARE, AMBIGUOUS_GAP = 2 / 3, 0.1
UNKNOWN = "und"

_CLASS = np.full(256, 32, np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_PRIME = np.uint32(2654435761)


def ngram_slots(buf: np.ndarray) -> np.ndarray:
    """Slots of the n-grams that start at each of the first len(buf) - 4 bytes, one row an order."""
    b = _CLASS[buf].astype(np.uint32)
    word = b[:-4] | b[1:-3] << np.uint32(8) | b[2:-2] << np.uint32(16) | b[3:-1] << np.uint32(24)
    out = np.empty((len(ORDERS), len(word)), np.uint32)
    for i, n in enumerate(ORDERS):
        part = word if n == 4 else word & np.uint32((1 << 8 * n) - 1)
        out[i] = ((part * _PRIME) >> np.uint32(32 - BUCKET_BITS)) + np.uint32(i << BUCKET_BITS)
    return out


def _slices(text: bytes):
    """The text with a space before and spaces behind, in slices that overlap by what an n-gram needs."""
    whole = b" " + text + b"    "
    for at in range(0, len(whole) - 4, SLICE):
        yield np.frombuffer(whole[at : at + SLICE + 4], np.uint8)


def counts_of(texts) -> np.ndarray:
    out = np.zeros(DIM, np.int64)
    for text in texts:
        for part in _slices(text):
            out += np.bincount(ngram_slots(part).ravel(), minlength=DIM)
    return out


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all splits for up to 5 classes, else the best of random codes of 10 log2 n bits."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits], np.int8).T.copy()
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        least = int(distance[~np.eye(n, dtype=bool)].min())
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: One row of log-odds a bit.
    weights: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Summed log-odds of each text (rows) and bit. A text's sums don't depend on the others."""
        return self.read(texts)[0]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of each text (rows) and bit, and the evidence of its runs for each language."""
        margins = np.zeros((len(texts), len(self.weights)), np.float64)
        evidence = np.zeros((len(texts), len(self.languages)), np.float64)
        if not len(self.weights):
            return margins, evidence
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > SLICE:
                for part in _slices(text):
                    self._add(part, np.array([len(part)]), [i], margins, evidence)
                continue
            group.append(i)
            size += len(text) + 5
            if size >= SLICE:
                self._group(texts, group, margins, evidence)
                group, size = [], 0
        if group:
            self._group(texts, group, margins, evidence)
        return margins, evidence

    def _group(self, texts, group, margins, evidence) -> None:
        buf = np.frombuffer(b"".join(b" " + texts[i] + b"    " for i in group), np.uint8)
        self._add(buf, np.array([len(texts[i]) + 5 for i in group]), group, margins, evidence)

    def _add(self, buf, lengths, group, margins, evidence) -> None:
        """Adds the n-grams of texts that lie one behind the other, each with the 4 bytes its last ones need."""
        starts = np.cumsum(lengths) - lengths
        parts = -(-(lengths - 4) // RUN) + 1  # the runs of a text, then the n-grams across its end
        first = np.cumsum(parts) - parts
        step = np.arange(parts.sum()) - np.repeat(first, parts)
        across = step == np.repeat(parts - 1, parts)
        cuts = np.where(across, np.repeat(starts + lengths - 4, parts), np.repeat(starts, parts) + RUN * step)[:-1]
        slots = ngram_slots(buf)
        runs = np.empty((len(self.weights), int((~across).sum())), np.float64)
        for bit, w in enumerate(self.weights):
            total = w[slots[0]]
            for row in slots[1:]:
                total = total + w[row]
            runs[bit] = np.add.reduceat(total.astype(np.float64), cuts)[~across[:-1]] * EVIDENCE
        of_text = first - np.arange(len(first))
        support = np.zeros((len(self.languages), runs.shape[1]))
        for bit, code in zip(runs, self.code.T, strict=True):
            support += code[:, None] * (bit / 2)
        own = support.argmax(axis=0)
        ahead = np.partition(support, -2, axis=0)
        ahead = np.minimum(ahead[-1] - ahead[-2], RUN_GAP)
        for bit in range(len(runs)):
            margins[group, bit] += np.add.reduceat(runs[bit], of_text)
        for k in range(len(support)):
            evidence[group, k] += np.add.reduceat(np.where(own == k, ahead, 0.0), of_text)

    def decode(self, margins: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the chosen language, score, whether the text is ambiguous."""
        n = len(margins)
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]).sum(axis=2)
        best = loss.argmin(axis=1)
        gap = np.partition(loss, 1, axis=1)[:, 1] - loss[np.arange(n), best]
        whole = evidence.sum(axis=1)
        score = np.where(whole > 0, evidence[np.arange(n), best] / np.where(whole > 0, whole, 1), 1 / len(self.languages))
        return best, score, (score < AMBIGUOUS_SHARE) | (gap < AMBIGUOUS_GAP)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 4000, max_languages: int = 512, alpha: float = 0.5) -> Model:
    """Learns from the rows' texts and non-null languages alone: a sample of about ``sample_docs`` texts of each of the
    ``max_languages`` languages with the most rows (ties by name), which bounds what comes to the driver."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).alias("h")).filter("text IS NOT NULL AND lang IS NOT NULL")
    # one count a language, on the driver as the model is; the sample is cut before anything is shuffled
    sizes = {r["lang"]: r["n"] for r in labelled.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not sizes:
        return Model([], codebook(0), np.zeros((0, DIM), np.float32))
    n = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(sizes.items()) for x in kv]), F.col("lang"))
    share = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(share * n < sample_docs).select("lang", "text").distinct()

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = counts_of([text.as_py().encode()])
                sums[lang] = sums[lang] + got if lang in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])
        give_back()

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("counts"))
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    per = sample.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
    got = sorted((r["lang"], np.frombuffer(r["counts"], "<i8")) for r in per.collect())
    languages = [k for k, _ in got]
    code = codebook(len(languages))
    if not languages or not code.shape[1]:
        return Model(languages, code, np.zeros((0, DIM), np.float32))
    share = np.stack([(c + alpha) / (c.sum() + alpha * DIM) for _, c in got])
    weights = np.stack([np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)) for bit in code.T])
    return Model(languages, code, weights.astype(np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple = ("doc_id",), prefix: str = "lang") -> DataFrame:
    """The columns of ``carry``, then <prefix>_pred, _score and _ambiguous, for every row."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and bits x DIM: fixed size
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), *carry)
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(f"{prefix}_pred", T.StringType()), T.StructField(f"{prefix}_score", T.DoubleType()), T.StructField(f"{prefix}_ambiguous", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield predict(pa, m, whole.slice(at, ROWS))
        give_back()

    def predict(pa, m, batch):
        n = batch.num_rows
        letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        names, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        if m.languages and letters.any():
            at = np.flatnonzero(letters)
            best, share, between = m.decode(*m.read([batch.column(0)[int(i)].as_py().encode() for i in at]))
            names[at], score[at], unsure[at] = np.array(m.languages, object)[best], share, between
        return pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], list(schema.names))

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
