"""Options of a conversion, validated on the driver."""

from __future__ import annotations

import os
import platform
import subprocess
import warnings
from dataclasses import dataclass, field
from typing import Any

DEFAULT_MODEL = "llama3.2-vision:11b"


@dataclass(frozen=True)
class PageConfig:
    """How pages are rendered. ``color_space`` and ``preserve_transparency`` are accepted and have no effect."""

    dpi: int = 400
    color_space: str = "RGB"
    include_annotations: bool = True
    preserve_transparency: bool = False
    #: Pass the page's own rotation to the renderer as well. Renderers that apply it by themselves would turn twice.
    pass_rotation: bool = False

    @property
    def scale(self) -> float:
        return self.dpi / 72 * 2


def device_config() -> tuple[str, int]:
    """(device, workers): graphics cards if ``nvidia-smi`` finds any, Apple's by platform, else half of the cores."""
    try:
        listed = subprocess.run(["nvidia-smi", "-L"], capture_output=True, text=True, timeout=10)
        cards = len([x for x in listed.stdout.splitlines() if x.strip()]) if listed.returncode == 0 else 0
    except (OSError, subprocess.SubprocessError):
        cards = 0
    return workers_for(cards, platform.system() == "Darwin" and platform.machine() == "arm64", os.cpu_count() or 2)


def workers_for(cards: int, apple: bool, cores: int) -> tuple[str, int]:
    if cards:
        return "cuda", min(2 * cards, 8)
    if apple:
        return "mps", 4
    return "cpu", max(2, cores // 2)


def local_server_env(device: str, workers: int, concurrent: bool, given: dict[str, Any] | None = None) -> dict[str, str]:
    """Settings of a local model server; every value is a default that ``given`` overrides.

    Fixed values: the names, which the server reads, and the defaults.
    """
    out: dict[str, Any] = {"OLLAMA_KEEP_ALIVE": -1}
    if concurrent:
        if device == "cuda":
            out |= {"OLLAMA_NUM_GPU": workers // 2, "OLLAMA_NUM_PARALLEL": workers * 8, "OLLAMA_GPU_LAYERS": "all"}
        elif device == "mps":
            out |= {"OLLAMA_NUM_GPU": 1, "OLLAMA_NUM_THREAD": workers, "OLLAMA_NUM_PARALLEL": workers * 8}
        else:
            out |= {"OLLAMA_NUM_THREAD": workers, "OLLAMA_NUM_PARALLEL": workers * 10}
    return {k: str(v) for k, v in (out | (given or {})).items()}


@dataclass(frozen=True)
class Options:
    """Everything a conversion can be told.

    ``image_mode``: None, "url" (figures by file name) or "base64" (data URIs).
    ``fallback_scope``: "page", or "document" to use the simple prompt from a
    document's first failed analysis on. ``mode``: "FAILFAST", or "PERMISSIVE"
    to keep failed pages with their error. ``figures_dir``: where figure files
    go in "url" mode; links are relative to it.
    """

    model_name: str = DEFAULT_MODEL
    api_key: str | None = None
    temperature: float = 0.7
    top_p: float = 0.7
    ollama_config: dict[str, Any] | None = None
    openai_config: dict[str, Any] | None = None
    gemini_config: dict[str, Any] | None = None
    image_mode: str | None = None
    custom_prompt: str | None = None
    detailed_extraction: bool = False
    extraction_complexity: bool = False
    enable_concurrency: bool = False
    num_workers: int | None = None
    page_config: PageConfig = field(default_factory=PageConfig)
    fallback_scope: str = "page"
    mode: str = "FAILFAST"
    figures_dir: str | None = None
    model_kwargs: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.extraction_complexity:
            if self.detailed_extraction:
                raise ValueError("extraction_complexity is the former name of detailed_extraction; give only the latter")
            warnings.warn("extraction_complexity is deprecated: use detailed_extraction", DeprecationWarning, stacklevel=3)
            object.__setattr__(self, "detailed_extraction", True)
        for name, allowed in (("image_mode", (None, "url", "base64")), ("fallback_scope", ("page", "document")), ("mode", ("FAILFAST", "PERMISSIVE"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")

    @property
    def workers(self) -> int:
        return self.num_workers if self.num_workers is not None else device_config()[1]
