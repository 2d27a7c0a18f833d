"""Language identification in two steps: the language's family, then the language within it.

Features are hashed byte trigrams and byte pairs of the whole lower-cased text, as square roots of counts, of unit length.
A one-versus-rest linear classifier picks the family; within a family of several languages one-versus-one linear
support vector machines vote by margin. The models are fitted on the driver from a bounded sample of labelled rows;
prediction reads every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, sliced
from .learning import bounded_sample, fit_slope, fit_svm, held_out

#: Families of language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
DIMENSIONS = 2048
SAMPLE_BOUND = 3000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    three = (b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    two = (b[:-1] * np.uint32(668265263) + b[1:] * np.uint32(374761393) + np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    x = np.sqrt(np.bincount(three, minlength=DIMENSIONS) + np.bincount(two, minlength=DIMENSIONS)).astype(np.float32)
    return x / np.linalg.norm(x)


@dataclass
class LanguageModel:
    """Weights as one matrix: a column per family, then a column per pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    pairs: list[tuple[int, int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    slopes: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ``und`` and 1 for null or letterless texts, ``und`` and 0 if nothing was learned."""
        if not has_letter(text):
            return UNKNOWN, 1.0
        if not self.families:
            return UNKNOWN, 0.0
        m = (features(text) @ self.weights + self.bias) * self.slopes
        p = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
        top = p[: len(self.families)]
        f = int(top.argmax())
        share = float(top[f] / max(1e-12, top.sum())) if len(top) > 1 else 1.0
        langs = self.members[f]
        if len(langs) == 1:
            return langs[0], share
        votes = np.zeros(len(langs))
        for k, (g, i, j) in enumerate(self.pairs, len(self.families)):
            if g == f:
                votes[i] += p[k]
                votes[j] += 1 - p[k]
        best = int(votes.argmax())
        return langs[best], share * float(votes[best] / (len(langs) - 1))


def fit(x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> LanguageModel:
    if not len(langs):
        return LanguageModel()
    lang = np.array(langs)
    family = np.array([families.get(c, c) for c in langs])
    out = LanguageModel(families=sorted(set(family)))
    out.members = [sorted(set(lang[family == f])) for f in out.families]
    columns = []
    for f in out.families:
        y = np.where(family == f, 1.0, -1.0)
        columns.append((*fit_svm(x, y), x, y) if len(out.families) > 1 else (np.zeros(x.shape[1]), 1.0, x, y))
    for g, names in enumerate(out.members):
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                own = (lang == names[i]) | (lang == names[j])
                y = np.where(lang[own] == names[i], 1.0, -1.0)
                columns.append((*fit_svm(x[own], y), x[own], y))
                out.pairs.append((g, i, j))
    out.weights = np.stack([c[0] for c in columns], axis=1).astype(np.float32)
    out.bias = np.array([c[1] for c in columns], dtype=np.float32)
    out.slopes = np.array([fit_slope(z @ w + b, y) for w, b, z, y in columns], dtype=np.float32)
    return out


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int = SAMPLE_BOUND) -> LanguageModel:
    """A model from at most about ``bound`` rows with a language and a letter; only their features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(lang, features(t).tobytes()) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.binary())], names=["lang", "x"])

    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    got = bounded_sample(known, id_col, bound).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, x binary").toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist()))  # no order of rows reaches the fit
    x = np.frombuffer(b"".join(p[1] for p in pairs), dtype=np.float32).reshape(-1, DIMENSIONS)
    return fit(x, [p[0] for p in pairs])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """docs with the columns held_out, lang_pred and score (replaced if there); all other columns and rows stay.

    Without a model, one is trained on the rows of docs that aren't held out. Null, empty or letterless text: ``und``
    with score 1. Null id: not held out, and never learned from. Without a row to learn from, texts with a letter are ``und``
    with score 0. Empty table: no rows. Columns held_out, lang_pred and score of docs are replaced.
    """
    ship(docs.sparkSession)
    if model is None:
        model = train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col)
    out = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x (families + pairs) numbers
    at = out.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches, at):
            found = [m.predict(t) for t in b.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    kinds = docs.select(*[held_out(id_col).alias("held_out"), *[f"`{c}`" for c in out]])
    at += 1
    schema = f"{_ddl(kinds)}, lang_pred string, score double"
    return kinds.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
