"""Model backends: what answers an analysis or a prompt, how it is called, and how it fails.

A backend makes its client on the executor, once for each partition; keys come
from its options or the executor's environment and never appear in a plan.
"""

from __future__ import annotations

import base64
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.config import device_config, local_server_env
from pagemill.errors import ModelCallError
from pagemill.operators.prompts import ANALYSIS
from pagemill.schema import ANALYSIS_FIELDS, FLAGS

# Structured calls are made with these, whatever the options.
STRUCTURED = {"temperature": 0.0, "top_p": 0.4}
ATTEMPTS, SHORTEST_WAIT, LONGEST_WAIT = 3, 4.0, 10.0
TIMEOUT, SDK_RETRIES = 240.0, 3


class Backend(Protocol):
    provider: str

    def client(self) -> Any: ...

    def call(self, client: Any, png: bytes | None, prompt: str, structured: bool) -> str: ...


def analysis_schema() -> dict:
    """The JSON schema that structured calls are held to."""
    kinds = {f: {"type": "string", "enum": ["Yes", "No"]} if f in FLAGS else {"type": "string"} for f in ANALYSIS_FIELDS}
    kinds["confidence_score_text"] = {"type": "number"}
    return {"type": "object", "properties": kinds, "required": list(ANALYSIS_FIELDS), "additionalProperties": False}


def with_retries(call: Callable[[], str], provider: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """Three attempts, with waits that double from one second and are held between 4 and 10; the last error is raised."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call()
        except Exception as error:
            if attempt == ATTEMPTS:
                raise ModelCallError(f"{provider}: {error}") from error
            sleep(min(LONGEST_WAIT, max(SHORTEST_WAIT, 2.0 ** (attempt - 1))))
    raise AssertionError


def answers(
    rows: DataFrame, backend: Backend, into: str, prompt: str | None = None, structured: bool = False, mode: str = "FAILFAST",
    image: str | None = None, concurrent: int = 1, sleep: Callable[[float], None] = time.sleep, unless: str | None = None,
) -> DataFrame:
    """``rows`` with the backend's answer, and ``into``_error in PERMISSIVE mode. One call for each row.

    ``prompt`` names a column; without it the analysis prompt is asked. Calls
    of a batch run in ``concurrent`` threads; a failing call is tried again by
    itself, not with its whole partition. Rows in which the column ``unless``
    isn't null aren't asked. Filter before this: Spark pushes no filter
    through it.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        with ThreadPoolExecutor(max(1, concurrent)) as pool:
            for batch in batches:
                skipped = batch[unless].notna() if unless else [False] * len(batch)
                client = backend.client() if client is None and not all(skipped) else client
                asked = batch[prompt] if prompt else [ANALYSIS] * len(batch)
                pngs = batch[image] if image else [None] * len(batch)

                def one(args: tuple) -> tuple[str | None, str | None]:
                    png, text, skip = args
                    if skip:
                        return None, None
                    try:
                        return with_retries(lambda: backend.call(client, png, text, structured), backend.provider, sleep), None
                    except ModelCallError as error:
                        if mode == "FAILFAST":
                            raise
                        return None, str(error)

                found = list(pool.map(one, zip(pngs, asked, skipped)))
                batch = batch.copy()
                batch[into] = [a for a, _ in found]
                batch[f"{into}_error"] = [e for _, e in found]
                yield batch

    out = rows.mapInPandas(run, f"{schema}, `{into}` string, `{into}_error` string")
    return out if mode == "PERMISSIVE" else out.drop(f"{into}_error")


@dataclass
class Scripted:
    """A deterministic backend: replies come from a function. It can be told to fail some of its calls."""

    reply: Callable[[bytes | None, str, bool], str]
    provider: str = "ollama"
    fails: Callable[[str, int], bool] | None = None
    tried: dict[str, int] = field(default_factory=dict)

    def client(self) -> None:
        return None

    def call(self, client: Any, png: bytes | None, prompt: str, structured: bool) -> str:
        self.tried[prompt] = self.tried.get(prompt, 0) + 1
        if self.fails is not None and self.fails(prompt, self.tried[prompt]):
            raise TimeoutError("no answer in time")
        return self.reply(png, prompt, structured)


def _missing(package: str, error: ImportError) -> ImportError:
    return ImportError(f"the {package} package is needed for this provider: install it on the driver and the executors ({error})")


@dataclass
class LocalServer:
    """A local model server that speaks the ollama protocol."""

    model: str
    config: dict[str, Any] = field(default_factory=dict)
    temperature: float = 0.7
    top_p: float = 0.7
    extra: dict[str, Any] = field(default_factory=dict)
    provider: str = "ollama"
    #: Settings of the server, for one that is started from this process.
    environment: dict[str, str] = field(default_factory=dict)

    def client(self) -> Any:
        try:
            import ollama
        except ImportError as error:
            raise _missing("ollama", error) from error
        timeout = float(self.config.get("OLLAMA_REQUEST_TIMEOUT", TIMEOUT))
        return ollama.Client(host=self.config.get("OLLAMA_HOST", "http://localhost:11434"), timeout=timeout, trust_env=False)

    def prepare(self, client: Any = None) -> None:
        """Driver set-up: settings, and the model is pulled if the server hasn't got it; any other error is raised."""
        os.environ.update(self.environment)
        client = self.client() if client is None else client
        try:
            client.show(self.model)
        except Exception as error:
            if getattr(error, "status_code", None) != 404:
                raise ModelCallError(f"{self.provider}: {error}") from error
            try:
                for _ in client.pull(self.model, stream=True):
                    pass
            except Exception as pulling:
                raise ModelCallError(f"{self.provider}: {pulling}") from pulling

    def call(self, client: Any, png: bytes | None, prompt: str, structured: bool) -> str:
        options = STRUCTURED if structured else {"temperature": self.temperature, "top_p": self.top_p, **self.extra}
        message = {"role": "user", "content": prompt, "images": [png] if png else []}
        made = client.chat(
            model=self.model, messages=[message], options=dict(options), format=analysis_schema() if structured else None,
            keep_alive=self.config.get("OLLAMA_KEEP_ALIVE", -1),
        )
        return made["message"]["content"]


@dataclass
class OpenAI:
    """OpenAI, or Azure if the options or the environment name its endpoint, or the options its key: it
    needs both. The deployment then stands for the model."""

    model: str
    api_key: str | None = None
    config: dict[str, Any] = field(default_factory=dict)
    temperature: float = 0.7
    top_p: float = 0.7
    extra: dict[str, Any] = field(default_factory=dict)
    provider: str = "openai"

    def _setting(self, name: str, default: Any = None) -> Any:
        return self.config.get(name, os.environ.get(name, default))

    @property
    def azure(self) -> bool:
        return bool(self._setting("AZURE_ENDPOINT_URL") or self.config.get("AZURE_OPENAI_API_KEY"))

    def check(self) -> None:
        """An error if Azure is asked for without its endpoint or key."""
        if self.azure and not (self._setting("AZURE_ENDPOINT_URL") and self._setting("AZURE_OPENAI_API_KEY")):
            raise ModelCallError(f"{self.provider}: Azure needs AZURE_ENDPOINT_URL and AZURE_OPENAI_API_KEY")

    @property
    def served(self) -> str:
        return self._setting("AZURE_DEPLOYMENT_NAME", self.model) if self.azure else self.model

    def client(self) -> Any:
        self.check()
        try:
            import openai
        except ImportError as error:
            raise _missing("openai", error) from error
        held = {"max_retries": int(self._setting("OPENAI_MAX_RETRIES", SDK_RETRIES)), "timeout": float(self._setting("OPENAI_TIMEOUT", TIMEOUT))}
        headers = self._setting("OPENAI_DEFAULT_HEADERS")
        if self.azure:
            return openai.AzureOpenAI(
                azure_endpoint=self._setting("AZURE_ENDPOINT_URL"), api_key=self._setting("AZURE_OPENAI_API_KEY"),
                api_version=self._setting("AZURE_OPENAI_API_VERSION", "2024-08-01-preview"), default_headers=headers, **held,
            )
        return openai.OpenAI(api_key=self.api_key, base_url=self._setting("OPENAI_BASE_URL"), default_headers=headers, **held)

    def request(self, png: bytes | None, prompt: str, structured: bool) -> dict[str, Any]:
        content: list[dict] = [{"type": "text", "text": prompt}]
        if png:
            content.append({"type": "image_url", "image_url": {"url": f"data:image/png;base64,{base64.b64encode(png).decode()}"}})
        asked: dict[str, Any] = {"model": self.served, "messages": [{"role": "user", "content": content}]}
        if structured:
            named = {"name": "page_analysis", "strict": True, "schema": analysis_schema()}
            return asked | STRUCTURED | {"response_format": {"type": "json_schema", "json_schema": named}}
        return asked | {"temperature": self.temperature, "top_p": self.top_p, **self.extra}

    def call(self, client: Any, png: bytes | None, prompt: str, structured: bool) -> str:
        return client.chat.completions.create(**self.request(png, prompt, structured)).choices[0].message.content


@dataclass
class Gemini:
    model: str
    api_key: str | None = None
    config: dict[str, Any] = field(default_factory=dict)
    temperature: float = 0.7
    top_p: float = 0.7
    extra: dict[str, Any] = field(default_factory=dict)
    provider: str = "gemini"

    def client(self) -> Any:
        try:
            from google import genai
        except ImportError as error:
            raise _missing("google-genai", error) from error
        return genai.Client(api_key=self.api_key)

    def call(self, client: Any, png: bytes | None, prompt: str, structured: bool) -> str:
        parts: list[Any] = [prompt]
        if png:
            from google.genai import types

            parts.insert(0, types.Part.from_bytes(data=png, mime_type="image/png"))
        held = {**STRUCTURED, "response_mime_type": "application/json", "response_schema": analysis_schema()}
        options = held if structured else {"temperature": self.temperature, "top_p": self.top_p, **self.extra}
        return client.models.generate_content(model=self.model, contents=parts, config=options).text


def backend_for(provider: str, options) -> Backend | None:
    """The backend of a provider, or None for one that isn't known."""
    common = {"temperature": options.temperature, "top_p": options.top_p, "extra": dict(options.model_kwargs)}
    if provider == "ollama":
        config = dict(options.ollama_config or {})
        device, workers = device_config()
        told = {k: v for k, v in config.items() if k not in ("OLLAMA_HOST", "OLLAMA_REQUEST_TIMEOUT")}
        environment = local_server_env(device, options.num_workers or workers, options.enable_concurrency, told)
        return LocalServer(options.model_name, config, environment=environment, **common)
    if provider == "openai":
        return OpenAI(options.model_name, options.api_key, dict(options.openai_config or {}), **common)
    if provider == "gemini":
        return Gemini(options.model_name, options.api_key, dict(options.gemini_config or {}), **common)
    return None
