"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import annotate, fold, pack, stage, unpack

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)  # bytes in a subword
DIM = 16
PER_LANG = 600  # labelled rows of one language that are learnt from, at most
PRIOR = 0.1 * BUCKETS  # subwords spread over all buckets that each language has besides its own
CHUNK = 1 << 19  # bytes of text hashed at a time
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def lowered(text: str) -> np.ndarray:
    """UTF-8 bytes of a text in lower case, between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)


def subwords(b: np.ndarray) -> np.ndarray:
    """Bucket of every run of 2, 3 and 4 bytes, order by order."""
    x = b.astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n, m in zip(ORDERS, _MULTIPLIERS, strict=True):
            if len(x) < n:
                continue
            h = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                h |= x[k : len(x) - n + 1 + k] << np.uint64(8 * k)
            out.append(((h + np.uint64(n)) * np.uint64(m) >> np.uint64(48)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    return np.unique(subwords(lowered(text)), return_counts=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """``table`` holds each bucket's embedding times the softmax weights, so that a text needs one gather and a mean.

    The softmax knows no language but the learnt ones.  So the table also has each bucket's evidence: the logarithm of how
    much more frequent it is in a language than if all buckets were alike.
    """

    langs: list[str]
    table: np.ndarray  # (BUCKETS, 2 x languages): weights, then evidence
    bias: np.ndarray
    temperature: float
    floor: float  # scores below it are rejected
    least: float  # so are texts whose mean evidence is below it for every language

    def means(self, text: str) -> np.ndarray:
        b = lowered(text)
        total, n = np.zeros(self.table.shape[1]), 0
        for i in range(0, len(b), CHUNK):  # pieces overlap by what the longest subword needs
            ids = subwords(b[i : i + CHUNK + max(ORDERS) - 1])
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1)

    def _softmax(self, means: np.ndarray) -> np.ndarray:
        return softmax((means[: len(self.langs)] + self.bias) / self.temperature)

    def probabilities(self, text: str) -> np.ndarray:
        return self._softmax(self.means(text))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in [0, 1], and whether score and evidence pass their calibrated floors."""
        if not has_letter(text):
            return UNKNOWN, 0.0, False
        means = self.means(text)
        p = self._softmax(means)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.floor and means[len(self.langs) :].max() >= self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def evidence(
    profiles: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: int, keep: float
) -> tuple[np.ndarray, float]:
    """Evidence of each bucket for each language, and the least mean evidence of a text in a learnt language.

    Each text is measured without its own counts, as a text that is to be kept (best of all languages), and without its
    language, as one that is to be rejected (best of the others).  The floor lies half-way between what ``keep`` of the
    first reach and what 99 % of the second, or no evidence at all, stay under; if these overlap, at the former.
    """
    counts = np.zeros((BUCKETS, langs))
    for (ids, c), k in zip(profiles, y, strict=True):
        counts[ids, k] += c
    sums = counts.sum(axis=0)
    table = np.log((counts + PRIOR / BUCKETS) * BUCKETS / (sums + PRIOR))
    own, foreign = [], [0.0]
    for (ids, c), k in zip(profiles, y, strict=True):
        n = c.sum()
        if n:
            e = c @ table[ids] / n
            rest = np.log((counts[ids, k] - c + PRIOR / BUCKETS) * BUCKETS / (sums[k] - n + PRIOR))
            others = np.delete(e, k)
            own.append(max([c @ rest / n, *others]))
            foreign += [others.max()] if langs > 1 else []
    if not own:
        return table, 0.0
    low = float(np.quantile(own, 1 - keep))
    return table, min(low, (low + max(0.0, float(np.quantile(foreign, 0.99)))) / 2)


def train(
    profiles: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 6, rate: float = 40.0, seed: int = 7,
    keep: float = 0.999, slack: float = 0.5,
) -> Model:
    """Stochastic gradient descent, one text a step; every fifth text is left out for calibration.

    The left-out texts set the temperature (least log loss over a grid) and the floor: the score that ``keep`` of the
    rightly recognised ones reach, times ``slack``.  What isn't in any learnt language is told by :func:`evidence`.
    """
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    w, bias = rng.normal(0, 1 / math.sqrt(DIM), (DIM, len(langs))), np.zeros(len(langs))
    use = [i for i, (ids, _) in enumerate(profiles) if len(ids)]
    left_out = [i for k, i in enumerate(use) if k % 5 == 4]
    learn = np.array([i for k, i in enumerate(use) if k % 5 != 4] or use, dtype=np.int64)
    weight = [c / max(c.sum(), 1) for _, c in profiles]
    steps, total = 0, max(1, epochs * len(learn))
    for _ in range(epochs):
        for i in rng.permutation(learn):
            ids, f = profiles[i][0], weight[i]
            hidden = f @ emb[ids]
            grad = softmax(hidden @ w + bias)
            grad[y[i]] -= 1.0
            lr = rate * (1 - steps / total)
            back = w @ grad
            w -= 0.1 * lr * np.outer(hidden, grad)
            bias -= 0.01 * lr * grad
            emb[ids] -= lr * f[:, None] * back[None, :]
            steps += 1
    table = emb @ w
    held = left_out or use
    z = np.array([(weight[i] @ table[profiles[i][0]]) + bias for i in held]).reshape(-1, len(langs))
    yh = y[held]
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), yh], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss) if len(held) else 1.0
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == yh] if len(held) else np.empty(0)
    floor = float(np.quantile(right, 1 - keep)) * slack if len(right) else 0.0
    known, least = evidence(profiles, y, len(langs), keep)
    return Model(langs, np.hstack([table, known]).astype(np.float32), bias, float(temperature), floor, least)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> Model | None:
    """A model of a bounded sample: up to ``per_lang`` rows of each language, those with the least hash of id and text.

    The sample is drawn from all given rows with a language and some letter, so a language with any such row is learnt.  Rows of
    equal id, text and language count once; null ids are told apart by their texts.  Profiles are taken from whole texts by the
    executors.  None if there are no such rows.
    """
    c = F.col
    rows = labelled.where(c(lang_col).isNotNull() & c(text_col).rlike(r"\p{L}")).select(
        c(lang_col).alias("lang"), F.xxhash64(c(id_col).cast("string"), c(text_col)).alias("key"), c(text_col).alias("text")
    )
    # Copies meet first; then the number of different keys tells how low the least ones must lie, so that few are ranked.
    keys = rows.select("lang", "key").distinct()
    share = F.least(F.lit(1.0), F.lit(4.0 * per_lang + 64) / c("n"))
    low = keys.join(keys.groupBy("lang").agg(F.count("*").alias("n")), "lang").where(c("key") / F.lit(2.0**64) + 0.5 <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = stage(low.select("lang", "key", rank.alias("r")).where(c("r") <= per_lang).drop("r"))
    sample = rows.join(chosen, ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("text").alias("text"))

    def run(texts: list[str]) -> list[list]:
        return [[pack(ids, n.astype(np.int32)) for ids, n in map(profile, texts)]]

    got = annotate(sample, "text", "profile binary", run, 64)
    found = sorted(((r.lang, r.key, r.profile) for r in got.toLocalIterator()), key=lambda x: x[:2])
    if not found:
        return None
    return train([tuple(unpack(p)) for _, _, p in found], [lang for lang, _, _ in found])


def identify(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw
) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_ok, in place of columns of these names; learns from ``labelled`` only.

    Only the text is looked at in a prediction.  Null texts and texts without a letter get ``und``, score 0 and are not
    ok; so does everything if nothing can be learnt.  Other rows get a learnt language, its calibrated probability, and
    ok if that and the evidence for some learnt language reach their calibrated floors.  Repeated rows get equal answers; whole texts are read, in pieces.
    """
    model = fit(labelled, id_col, text_col, lang_col, **kw)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x 2 x languages floats

    def run(texts: list[str | None]) -> list[list]:
        m = shared.value
        out = [m.predict(t) if m else (UNKNOWN, 0.0, False) for t in texts]
        return [list(x) for x in zip(*out, strict=True)]

    with_text = docs.drop("lang_pred", "lang_score", "lang_ok").withColumn("_llm_text", F.col(text_col))
    return annotate(with_text, "_llm_text", "lang_pred string, lang_score double, lang_ok boolean", run)


def labelled_fold(docs: DataFrame, id_col: str = "doc_id", modulus: int = 4, out: int = 2) -> DataFrame:
    return docs.where(fold(F.col(id_col), modulus) != out)
