"""The public conversion: documents in, markdown pages out."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Options
from pagemill.errors import ConversionError, UnsupportedModelError
from pagemill.operators import backends, collect, routing
from pagemill.operators.figures import append_figures, page_figures, ranked_pngs
from pagemill.operators.registry import provider_of, vision_models
from pagemill.sources import pdf, sinks
from pagemill.sources.staging import written


def local_models() -> Mapping[str, str]:
    """The image models of the local server, if its client is installed, it runs and Spark does."""
    try:
        import ollama
    except ImportError:
        return {}
    client = ollama.Client()
    names = lambda: [m["model"] for m in client.list()["models"]]
    return dict.fromkeys(vision_models(SparkSession.active(), names, client.show), "ollama")


class Converter:
    """Turns PDF files, or page rows, into markdown.

    ``backend`` and ``reader`` default to those that the options name; a model
    that the registry doesn't know is looked for by ``discover``, by default
    on the local server. Pages and analyses are materialised before routes
    part, by ``materialise`` (written as Parquet by default, in the folder
    ``spark.checkpoint.dir``), so that no page is rendered or analysed twice.
    """

    def __init__(
        self, options: Options | None = None, backend: backends.Backend | None = None, reader: pdf.Reader | None = None,
        discover: Callable[[], Mapping[str, str]] = local_models, materialise: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        self.options = options or Options()
        if backend is None:
            provider = provider_of(self.options.model_name, discover)
            backend = backends.backend_for(provider, self.options)
            if backend is None:
                raise UnsupportedModelError(f"no backend for provider {provider}")
        if hasattr(backend, "check"):
            backend.check()
        self.backend, self.reader = backend, reader or pdf.PdfiumReader()
        self.materialise = materialise or written
        self._prepared = False

    def prepare(self) -> None:
        """Set-up on the driver, once: a model that the local server lacks is pulled."""
        if not self._prepared and hasattr(self.backend, "prepare"):
            self.backend.prepare()
        self._prepared = True

    def convert_pages(self, pages: DataFrame) -> DataFrame:
        """``pages`` (doc_id, page_number, png and others) with route, prompt, markdown and error.

        Pages that have an ``error`` already are handed on, without a call.
        """
        self.prepare()
        o = self.options
        if "error" not in pages.columns:
            pages = pages.withColumn("error", F.lit(None).cast("string"))
        elif not o.detailed_extraction:
            pages = self.materialise(pages)  # failed pages part from the others below
        calls = {"mode": o.mode, "image": "png" if "png" in pages.columns else None, "concurrent": o.workers if o.enable_concurrency else 1}
        if o.detailed_extraction:
            # an analysis that fails isn't the page's failure: the page takes the simple prompt
            asked = backends.answers(pages, self.backend, "reply", structured=True, unless="error", **(calls | {"mode": "PERMISSIVE"}))
            asked = asked.drop("reply_error")
        else:
            asked = pages.withColumn("reply", F.lit(None).cast("string"))
        routed = routing.with_routes(
            asked, self.backend.provider, o.image_mode, o.detailed_extraction, o.custom_prompt, o.fallback_scope
        )
        if o.detailed_extraction:
            routed = self.materialise(routed)

        def describe(rows: DataFrame) -> DataFrame:
            asked = backends.answers(rows, self.backend, "answer", "prompt", **calls)
            if o.mode == "PERMISSIVE":
                asked = asked.withColumn("error", F.col("answer_error")).drop("answer_error")
            return asked

        out = routing.converted(routed, describe)
        if o.image_mode is not None and o.detailed_extraction and "regions" in pages.columns:
            wanted = (F.col("route") == routing.TAILORED) & routing.wants_figures(F.col("analysis"), o.image_mode)
            if o.image_mode == "url":
                out = out.withColumn("pngs", F.when(wanted, ranked_pngs(F.col("regions")))).drop("png", "regions")
                out = sinks.with_figure_files(out, "pngs", self._figures_dir(pages.sparkSession))
            else:
                out = out.withColumn("figures", F.when(wanted, page_figures(F.col("regions"), F.col("page_number"), o.image_mode)))
            out = out.withColumn("markdown", append_figures(F.col("markdown"), F.col("figures")))
        return out

    def _figures_dir(self, spark: SparkSession) -> str:
        if self.options.figures_dir:
            return self.options.figures_dir
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError('image_mode "url" writes files: set figures_dir to a folder that all executors share')
        return os.getcwd()

    def convert(self, spark: SparkSession, path: str) -> DataFrame:
        """(doc_id, page_number, route, markdown, error) of all PDF files at a path; error is null but in PERMISSIVE mode."""
        files = pdf.read_files(spark, path)
        pages = pdf.page_rows(files, self.reader, self.options.page_config, self.options.mode, self.options.image_mode is not None)
        if self.options.mode == "FAILFAST":
            pages = pages.drop("error")  # there, failures are raised
        return self.convert_pages(pages).select("doc_id", "page_number", "route", "markdown", "error")

    def convert_pdf(self, spark: SparkSession, path: str) -> list[str]:
        """One PDF's pages, in order."""
        pdf.check_path(spark, path)
        try:
            return sinks.as_list(self.convert(spark, path))
        except ConversionError:
            raise
        except Exception as error:
            raise ConversionError(f"{path}: {error}") from error

    def documents(self, spark: SparkSession, path: str) -> DataFrame:
        return collect.documents(self.convert(spark, path))
