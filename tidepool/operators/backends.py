"""Models that a caller may bring: sentiment classifiers, text encoders, aspect extractors. Each has a fallback that needs no model.

A model is loaded where its batches are, once a task; what it can't do falls
back to the lexicon, to hashed tokens or to keywords, as the caller asked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspects, sentiment
from ..sources.readers import read_text, write_text
from .retrieval import DIMENSIONS, LEAST_DIMENSIONS, embedding

#: Names that ask for no model, texts that a model gets at once, and the file that says which backend made an index.
NO_MODEL, BATCH, METADATA = ("lexicon", "rule-based", "rule_based"), 32, "embedding_backend.json"
#: A model: a list of texts to a prediction for each, a dict or a list of dicts with label and score.
Classifier = Callable[[Sequence[str]], Sequence[object]]


def _number(value: object, otherwise: float) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return otherwise


def signed_score(prediction: object) -> float:
    """A prediction as a score from -1 to 1: the surest of several, twice its confidence less one, by the label's sign.

    A confidence below a half turns the sign; one that is missing or can't be read counts as a half, so 0.
    """
    if isinstance(prediction, (list, tuple)):
        prediction = max((p for p in prediction if isinstance(p, dict)), key=lambda p: _number(p.get("score"), 0.0), default={})
    if not isinstance(prediction, dict):
        return 0.0
    sure = min(1.0, max(0.0, _number(prediction.get("score"), 0.5)))
    label = str(prediction.get("label") or "").strip().lower()
    sign = next((s for s in (1, -1) if label in sentiment.MODEL_LABELS[s] or sentiment.MODEL_LABELS[s][0] in label), 0)
    return round(sign * (2 * sure - 1), 4)


def classifier(load: Callable[[], Classifier], batch: int = BATCH) -> Callable[[str], Column]:
    """A sentiment backend of a model that ``load`` gives in each task. Blank texts score 0 unseen."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out = pd.Series(0.0, texts.index)
            asked = texts[texts.fillna("").str.strip() != ""]
            for at in range(0, len(asked), batch):
                part = asked.iloc[at : at + batch]
                out.loc[part.index] = [signed_score(p) for p in model(part.tolist())]
            yield out

    return lambda c: score(F.col(c))


@dataclass(frozen=True)
class Backend:
    """What was chosen, and why if it isn't what was asked for."""

    name: str
    model: str
    dimensions: int | None = None
    reason: str | None = None


def sentiment_backend(model: str = "lexicon", load: Callable[[str], Classifier] | None = None) -> tuple[Backend, Callable[[str], Column]]:
    """The model of that name if it loads here, else the lexicon."""
    if model.strip().lower() in NO_MODEL or not model.strip():
        return Backend("lexicon", "lexicon"), sentiment.lexicon_score
    try:
        if load is None:
            raise LookupError("no loader was given")
        load(model)
    except Exception as e:  # whatever a model's library raises
        return Backend("lexicon", "lexicon", reason=f"{type(e).__name__}: {e}"), sentiment.lexicon_score
    return Backend("model", model), classifier(lambda: load(model))


def hashing_dimensions(model: str) -> int:
    """Of "hashing-256"; anything else has the usual number."""
    found = re.fullmatch(r"hashing-(\d+)", model.strip().lower())
    return max(LEAST_DIMENSIONS, int(found[1])) if found else DIMENSIONS


def embedding_backend(spark: SparkSession, folder: str | None = None, model: str | None = None, load: Callable[[str], Callable] | None = None, fall_back: bool = True) -> tuple[Backend, Callable[[str], Column]]:
    """The backend that made the folder's index, or the one asked for, or hashing.

    An index that a model made can't be searched with another one, so that case
    is an error if the model doesn't load.
    """
    saved = json.loads(read_text(spark, f"{folder}/{METADATA}") or "{}") if folder else {}
    hashed = lambda n, name, reason=None: (Backend("hashing", name, n, reason), lambda c: embedding(c, n))
    if saved.get("name") == "hashing":
        n = int(saved.get("dimensions") or DIMENSIONS)
        return hashed(n, saved.get("model") or f"hashing-{n}", saved.get("reason"))
    asked = model or saved.get("model") or "hashing"
    if asked.strip().lower() in ("hash", "hashing") or asked.strip().lower().startswith("hashing-"):
        n = hashing_dimensions(asked)
        return hashed(n, f"hashing-{n}")
    try:
        if load is None:
            raise LookupError("no loader was given")
        load(asked)
    except Exception as e:  # whatever a model's library raises
        if saved.get("name") == "model":
            raise RuntimeError(f"the index was made by {saved['model']}, which doesn't load; rebuild it to search by hashing") from e
        if not fall_back:
            raise
        return hashed(DIMENSIONS, f"hashing-{DIMENSIONS}", f"{type(e).__name__}: {e}")

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(asked)
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in encoder(texts.fillna("").tolist())], texts.index)

    return Backend("model", asked), lambda c: encode(F.col(c))


def save_backend(spark: SparkSession, folder: str, backend: Backend) -> None:
    write_text(spark, f"{folder}/{METADATA}", json.dumps(asdict(backend), sort_keys=True))


def parse_aspects(answer: str | None) -> list[tuple[str, float, str]]:
    """(aspect, sentiment, quote) of a model's JSON answer, with or without a code fence around it."""
    text = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", (answer or "").strip())
    try:
        said = json.loads(text)
    except ValueError:
        return []
    if isinstance(said, dict):
        said = said.get("aspects") or []
    out = []
    for record in said if isinstance(said, list) else []:
        if isinstance(record, dict) and str(record.get("aspect") or "").strip():
            try:
                score = min(1.0, max(-1.0, float(record.get("sentiment") or 0)))
            except (TypeError, ValueError):
                score = 0.0
            out.append((str(record["aspect"]), score, str(record.get("quote") or "")))
    return out


def asked_aspects(ask: Callable[[], Callable[[str], str]], **options) -> Callable[[str], Column]:
    """An extractor that asks a service about each text (``ask`` gives the asking function in each task).

    Where the service fails or names nothing, keywords decide.
    """

    @F.pandas_udf("array<struct<aspect:string,sentiment:double,quote:string>>")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        service = ask()
        for texts in batches:
            out = []
            for t in texts.fillna("").tolist():
                try:
                    found = parse_aspects(service(t)) if t.strip() else []
                except Exception:  # whatever a service's client raises
                    found = []
                out.append([{"aspect": a, "sentiment": s, "quote": q} for a, s, q in found])
            yield pd.Series(out, texts.index)

    def extract(c: str) -> Column:
        said = aspects.deduplicated(answers(F.col(c)), **options)
        return F.when(F.size(said) > 0, said).otherwise(aspects.extract(c, **options))

    return extract


def generated_answer(generate: Callable[[str, list[dict]], str] | None, query: str, found: list[dict], otherwise: Callable[[str, list[dict]], str]) -> str:
    """A model's answer from the reviews found; ``otherwise`` where there is no model, nothing found, or it fails or says nothing."""
    if generate is None or not found:
        return otherwise(query, found)
    try:
        return (generate(query, found) or "").strip() or otherwise(query, found)
    except Exception:  # whatever a service's client raises
        return otherwise(query, found)


def in_parts(df: DataFrame, backend: Backend, extra: dict | None = None) -> dict:
    """What a run's progress marker says about how it was made."""
    return {**asdict(backend), "columns": df.columns, **(extra or {})}
