"""Which provider serves a model, and which local models take images."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.errors import UnsupportedModelError

# Models whose provider is known without asking a server.
STATIC_MODELS = {
    "llama3.2-vision:11b": "ollama",
    "gpt-4o": "openai",
    "gpt-4o-mini": "openai",
    "gemini-2.5-pro": "gemini",
    "gemini-2.5-flash": "gemini",
    "gemini-2.0-flash": "gemini",
}


def _provider(model: Column, models: Mapping[str, str]) -> Column:
    """The provider of a model by a map that is part of the expression; null for none."""
    if not models:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in models.items() for x in pair]), model)


def resolve(requests: DataFrame, static: Mapping[str, str], dynamic: Mapping[str, str], model: str = "model") -> DataFrame:
    """``requests`` with ``provider`` and ``resolved_by``: the static registry wins, then what was
    discovered; both null for unknown models. A registry is a handful of models, so it is looked up
    inside the row, and requests stay where they are."""
    fixed, found = _provider(F.col(model), static), _provider(F.col(model), dynamic)
    by = F.when(fixed.isNotNull(), "static").when(found.isNotNull(), "dynamic")
    return requests.withColumns({"provider": F.coalesce(fixed, found), "resolved_by": by})


def provider_of(model: str, discover: Callable[[], Mapping[str, str]] = dict) -> str:
    """The provider of one model. A discovery that fails has found nothing."""
    if model in STATIC_MODELS:
        return STATIC_MODELS[model]
    try:
        found = dict(discover())
    except Exception:
        found = {}
    if model in found:
        return found[model]
    raise UnsupportedModelError(f"{model} is none of {', '.join(sorted(STATIC_MODELS | found))}")


def takes_images(capabilities: Column, families: Column) -> Column:
    """A model takes images if it says so, or if its families include an image encoder."""
    yes = F.coalesce(F.array_contains(capabilities, "vision"), F.lit(False))
    return yes | F.coalesce(F.array_contains(families, "clip"), F.lit(False))


def vision_models(spark: SparkSession, names: Callable[[], Iterable[str]], show: Callable[[str], Mapping]) -> set[str]:
    """The models of a local server that take images.

    Each model is asked for once, on the driver; what they say becomes a small
    table that ``takes_images`` is evaluated on. A model that can't be asked
    takes none, and a server that doesn't list its models has none.
    """
    rows = []
    try:
        listed = list(dict.fromkeys(names()))
    except Exception:
        return set()
    strings = lambda x: [str(v) for v in x] if isinstance(x, (list, tuple)) else None
    for name in listed:
        try:
            said = show(name)
            rows.append((name, strings(said.get("capabilities")), strings((said.get("details") or {}).get("families"))))
        except Exception:
            rows.append((name, None, None))
    told = spark.createDataFrame(rows, "model string, capabilities array<string>, families array<string>")
    return {r["model"] for r in told.where(takes_images(F.col("capabilities"), F.col("families"))).collect()}


def discovery(spark: SparkSession, names: Callable[[], Iterable[str]], show: Callable[[str], Mapping], provider: str = "ollama") -> Callable[[], Mapping[str, str]]:
    """A discovery for ``provider_of``: the image models of a local server, asked for when they are needed, once."""
    found: dict[str, str] = {}

    def discover() -> Mapping[str, str]:
        if not found:
            found.update(dict.fromkeys(vision_models(spark, names, show), provider))
        return found

    return discover
