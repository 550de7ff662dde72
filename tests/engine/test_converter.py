import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.config import Options, PageConfig, local_server_env, workers_for
from pagemill.errors import ConversionError, ModelCallError, UnsupportedFileError, UnsupportedModelError
from pagemill.operators import backends, figures, registry, routing
from pagemill.plans.converter import Converter
from pagemill.sources import pdf, sinks


class FakeReader:
    """Pages are parted by form feeds; a page named broken can't be rendered."""

    def open(self, content):
        if content.startswith(b"bad"):
            raise ValueError("no document")
        return content.decode().split("\f")

    def pages(self, document):
        return len(document)

    def rotation(self, document, ordinal):
        return 0

    def render(self, document, ordinal, scale, rotation, annotations):
        if document[ordinal] == "broken":
            raise ValueError("no page")
        page = np.full((300, 260, 3), 255, np.uint8)
        if document[ordinal] == "figure":
            page[40:180, 50:200] = np.linspace(40, 180, 150)[None, :, None].astype(np.uint8)
        return page

    def close(self, document):
        raise RuntimeError("ignored")


class Counting:
    """A backend that writes down each call in a file, so that calls of all workers are seen."""

    provider = "ollama"

    def __init__(self, log, analysis):
        self.log, self.analysis = log, analysis

    def client(self):
        return None

    def call(self, client, png, prompt, structured):
        with open(self.log, "a") as f:
            f.write("s\n" if structured else "f\n")
        return self.analysis if structured else "```markdown\nanswer\n```"


def analysis(**other):
    base = {"text_detected": "Yes", "tables_detected": "No", "images_detected": "No", "latex_equations_detected": "No", "extracted_text": "found", "confidence_score_text": 0.9}
    return json.dumps(base | other)


def written(folder, **files):
    for name, text in files.items():
        (folder / name.replace("_", ".")).write_bytes(text.encode())
    return str(folder)


def calls(path):
    return path.read_text().split() if path.exists() else []


def test_direct_pages_take_one_call_and_keep_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = written(tmp_path / "in", a_pdf="one\ftwo\fthree", b_PDF="four", c_txt="no")
    log = tmp_path / "log"
    out = Converter(Options(detailed_extraction=True), Counting(str(log), analysis()), FakeReader()).convert(spark, where)
    rows = sorted(tuple(r) for r in out.collect())
    assert [(r[0].rpartition("/")[2], r[1], r[2], r[3]) for r in rows] == [("a.pdf", i, "direct", "found") for i in range(3)] + [("b.PDF", 0, "direct", "found")]
    assert calls(log) == ["s"] * 4


@pytest.mark.parametrize("reply,want", [(analysis(tables_detected="Yes"), "answer"), ("not json", "answer"), (analysis(text_detected="No"), "")])
def test_calls_by_route(spark, tmp_path, reply, want):
    (tmp_path / "in").mkdir()
    where, log = written(tmp_path / "in", a_pdf="one\ftwo"), tmp_path / "log"
    rows = Converter(Options(detailed_extraction=True), Counting(str(log), reply), FakeReader()).convert(spark, where).collect()
    assert [r["markdown"] for r in rows] == [want] * 2
    assert sorted(calls(log)) == (["f"] * 2 if want else []) + ["s"] * 2


def test_simple_mode_and_list(spark, tmp_path):
    (tmp_path / "in").mkdir()
    written(tmp_path / "in", a_pdf="one\ftwo")
    log = tmp_path / "log"
    got = Converter(Options(), Counting(str(log), "x"), FakeReader()).convert_pdf(spark, str(tmp_path / "in" / "a.pdf"))
    assert got == ["answer", "answer"] and calls(log) == ["f", "f"]
    with pytest.raises(FileNotFoundError):
        Converter(Options(), Counting(str(log), "x"), FakeReader()).convert_pdf(spark, str(tmp_path / "none.pdf"))
    (tmp_path / "x.txt").write_text("t")
    with pytest.raises(UnsupportedFileError):
        Converter(Options(), Counting(str(log), "x"), FakeReader()).convert_pdf(spark, str(tmp_path / "x.txt"))


def test_figures_are_appended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where, log = written(tmp_path / "in", a_pdf="plain\ffigure"), tmp_path / "log"
    for mode in ("url", "base64"):
        backend = Counting(str(log), analysis(images_detected="Yes"))
        options = Options(detailed_extraction=True, image_mode=mode, figures_dir=str(tmp_path / "figures"))
        rows = sorted(Converter(options, backend, FakeReader()).convert(spark, where).collect(), key=lambda r: r["page_number"])
        assert rows[0]["markdown"] == "answer"
        if mode == "base64":
            assert rows[1]["markdown"].startswith("answer\n\n![image_2_1.png](data:image/png;base64,iVBOR")
    (file,) = (tmp_path / "figures").rglob("*.png")  # written once, where the link says
    assert file.read_bytes().startswith(b"\x89PNG")
    url = Converter(Options(detailed_extraction=True, image_mode="url", figures_dir=str(tmp_path / "figures")), backend, FakeReader()).convert(spark, where)
    link = f"{file.parent.name}/image_2_1.png"
    assert [r["markdown"] for r in url.where("page_number = 1").collect()] == [f"answer\n\n![image_2_1.png]({link})"]


def test_a_figure_that_cannot_be_written_uses_up_no_number(spark):
    df = spark.createDataFrame([("/x/a.pdf", 4, [b"1", b"bad", b"3"]), ("/x/a.pdf", 5, None)], "doc_id string, page_number int, pngs array<binary>")

    def write(name, content):
        if content == b"bad":
            raise OSError("full")

    got = {r["page_number"]: r["figures"] for r in sinks.with_figure_files(df, "pngs", "/nowhere", write=write).collect()}
    assert [f["image_url"].rpartition("/")[2] for f in got[4]] == ["image_5_1.png", "image_5_2.png"] and got[5] is None


@pytest.mark.parametrize("detailed", [False, True])
def test_failed_pages_are_kept_and_no_model_sees_them(spark, tmp_path, detailed):
    (tmp_path / "in").mkdir()
    where, log = written(tmp_path / "in", a_pdf="one\fbroken", b_pdf="bad"), tmp_path / "log"
    options = Options(detailed_extraction=detailed, mode="PERMISSIVE")
    rows = sorted(Converter(options, Counting(str(log), "no json"), FakeReader()).convert(spark, where).collect(), key=lambda r: (r["doc_id"], r["page_number"] or 0))
    assert calls(log) == (["s", "f"] if detailed else ["f"])
    assert [r["markdown"] for r in rows] == ["answer", None, None] and rows[0]["error"] is None
    assert rows[1]["error"].endswith("a.pdf, page 2: no page") and rows[2]["error"].endswith("b.pdf: no document")
    assert [r["route"] for r in rows] == ["fallback" if detailed else "simple", "failed", "failed"]


class Refusing(Counting):
    def call(self, client, png, prompt, structured):
        if not structured:
            raise TimeoutError("late")
        return super().call(client, png, prompt, structured)


def test_errors_of_calls_are_returned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backends, "SHORTEST_WAIT", 0)
    df = spark.createDataFrame([("a", 0)], "doc_id string, page_number int")
    options = Options(detailed_extraction=True, mode="PERMISSIVE")
    backend = Refusing(str(tmp_path / "log"), analysis(tables_detected="Yes"))
    quick = lambda rows, *a, **k: backends_answers(rows, *a, **(k | {"sleep": no_wait}))
    backends_answers = backends.answers
    monkeypatch.setattr(backends, "answers", quick)
    (row,) = Converter(options, backend).convert_pages(df).collect()
    assert row["markdown"] is None and row["error"] == "ollama: late" and row["route"] == "tailored"


def no_wait(seconds):
    pass


def test_fenced_analyses_are_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where, log = written(tmp_path / "in", a_pdf="one"), tmp_path / "log"
    rows = Converter(Options(detailed_extraction=True), Counting(str(log), f"```\n{analysis()}\n```"), FakeReader()).convert(spark, where).collect()
    assert [(r["route"], r["markdown"]) for r in rows] == [("direct", "found")] and calls(log) == ["s"]


def test_pages_whose_figures_cannot_be_searched_fall_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where, log = written(tmp_path / "in", a_pdf="one\ftwo"), tmp_path / "log"

    def search(pixels):
        raise figures.FigureError("odd raster")

    pages = pdf.page_rows(pdf.read_files(spark, where), FakeReader(), with_regions=True, search=search)
    assert all(r["figure_error"].endswith("odd raster") and r["png"] and r["error"] is None for r in pages.collect())
    options = Options(detailed_extraction=True, image_mode="base64")
    for reply, want in ((analysis(images_detected="Yes"), "fallback"), (analysis(), "direct"), (analysis(text_detected="No", images_detected="Yes"), "blank")):
        rows = Converter(options, Counting(str(log), reply), FakeReader()).convert_pages(pages).collect()
        assert {r["route"] for r in rows} == {want} and all(r["error"] is None for r in rows)


def test_azure_needs_both_settings(monkeypatch):
    for name in ("AZURE_ENDPOINT_URL", "AZURE_OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    for config in ({"AZURE_OPENAI_API_KEY": "k"}, {"AZURE_ENDPOINT_URL": "e"}):
        with pytest.raises(ModelCallError, match="AZURE_ENDPOINT_URL"):
            Converter(Options(model_name="gpt-4o", openai_config=config))
    Converter(Options(model_name="gpt-4o", openai_config={"AZURE_OPENAI_API_KEY": "k", "AZURE_ENDPOINT_URL": "e"}))


class FakeServer:
    """Stands for the client package of the local server."""

    pulled: list = []

    def __init__(self, **kwargs):
        self.kwargs = kwargs

    def list(self):
        return {"models": [{"model": "mine"}, {"model": "blind"}]}

    def show(self, name):
        if name == "absent":
            error = RuntimeError("not found")
            error.status_code = 404
            raise error
        if name == "down":
            raise OSError("no server")
        return {"capabilities": ["vision"] if name == "mine" else ["completion"]}

    def pull(self, name, stream):
        FakeServer.pulled.append(name)
        return iter([{"status": "done"}])


def test_local_models_are_discovered_and_pulled(spark, monkeypatch):
    import sys
    import types

    monkeypatch.setitem(sys.modules, "ollama", types.SimpleNamespace(Client=FakeServer))
    monkeypatch.delenv("OLLAMA_KEEP_ALIVE", raising=False)
    assert Converter(Options(model_name="mine")).backend.provider == "ollama"
    with pytest.raises(UnsupportedModelError, match="mine"):
        Converter(Options(model_name="blind"))
    backend = backends.LocalServer("absent", environment={"OLLAMA_KEEP_ALIVE": "-1"})
    converter = Converter(Options(), backend, FakeReader())
    converter.prepare()
    converter.prepare()
    import os

    assert FakeServer.pulled == ["absent"] and os.environ.pop("OLLAMA_KEEP_ALIVE") == "-1"
    assert backend.client().kwargs["trust_env"] is False
    with pytest.raises(ModelCallError, match="no server"):
        Converter(Options(), backends.LocalServer("down"), FakeReader()).prepare()
    options = Options(enable_concurrency=True, num_workers=4, ollama_config={"OLLAMA_HOST": "h", "OLLAMA_NUM_PARALLEL": 3})
    made = backends.backend_for("ollama", options).environment
    assert made["OLLAMA_NUM_PARALLEL"] == "3" and "OLLAMA_HOST" not in made


def test_public_names():
    import pagemill

    assert all(getattr(pagemill, name) for name in pagemill.__all__) and pagemill.Converter is Converter
    with pytest.raises(AttributeError):
        pagemill.nothing


def test_parsers_are_compared_and_reported(spark, tmp_path):
    from datetime import datetime

    from pagemill.plans import benchmark

    class Result:
        text_content = "one two three four\nfive"

    (tmp_path / "truth.md").write_text("one two three four\nfive")
    runs = []
    parsers = {"z first": lambda p: runs.append(p) or ["one two three four", "five"], "a second": lambda p: Result(), "b third": lambda p: 7}
    out = benchmark.compare(spark, parsers, "x.pdf", str(tmp_path / "truth.md"), str(tmp_path / "report.md"), runs=2, now=lambda: datetime(2025, 1, 3)).collect()
    assert [r["parser"] for r in out] == list(parsers) and runs == ["x.pdf"] * 2
    assert [round(r["avg_accuracy"], 3) for r in out[:2]] == [1.0, 1.0] and out[2]["avg_accuracy"] < 0.1 and out[0]["num_runs"] == 2
    text = (tmp_path / "report.md").read_text()
    assert "2025-01-03" in text and text.index("z first") < text.index("a second")


def test_broken_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = written(tmp_path / "in", a_pdf="one\fbroken", b_pdf="bad")
    files = pdf.read_files(spark, where)
    rows = sorted(pdf.page_rows(files, FakeReader(), mode="PERMISSIVE").collect(), key=lambda r: r["error"] or "")
    assert rows[0]["page_number"] == 0 and rows[1]["error"].endswith("a.pdf, page 2: no page") and rows[2]["error"].endswith("b.pdf: no document")
    with pytest.raises(Exception, match="page 2"):
        pdf.page_rows(files.where("path like '%a.pdf'"), FakeReader()).collect()
    assert pdf.read_files(spark, where, largest=3).count() == 1
    with pytest.raises(ConversionError):
        Converter(Options(), Counting(str(tmp_path / "log"), "x"), FakeReader()).convert_pdf(spark, str(tmp_path / "in" / "a.pdf"))


def test_retries():
    waits, tries = [], []

    def failing(n):
        tries.append(1)
        if len(tries) <= n:
            raise TimeoutError("late")
        return "ok"

    assert backends.with_retries(lambda: failing(2), "x", waits.append) == "ok" and waits == [4.0, 4.0]
    tries.clear()
    with pytest.raises(ModelCallError, match="x: late"):
        backends.with_retries(lambda: failing(9), "x", waits.append)
    assert len(tries) == 3


def test_failing_backend_by_mode(spark):
    from pagemill.plans import catalogue

    rows = catalogue.q21_retry_backend(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert (r["answer"] is None) == (r["doc_id"] % 10 == 0) == (r["answer_error"] == "ollama: no answer in time")


def test_requests_of_providers(monkeypatch):
    monkeypatch.delenv("AZURE_ENDPOINT_URL", raising=False)
    o = Options(model_name="gpt-4o", model_kwargs={"max_tokens": 9})
    plain = backends.backend_for("openai", o)
    asked = plain.request(b"png", "p", False)
    assert asked["model"] == "gpt-4o" and asked["temperature"] == 0.7 and asked["max_tokens"] == 9
    assert asked["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    azure = backends.OpenAI("gpt-4o", config={"AZURE_ENDPOINT_URL": "e", "AZURE_DEPLOYMENT_NAME": "mine"})
    held = azure.request(None, "p", True)
    assert held["model"] == "mine" and held["temperature"] == 0.0 and held["top_p"] == 0.4 and held["response_format"]["type"] == "json_schema"
    assert backends.backend_for("nobody", o) is None
    for provider in ("ollama", "openai", "gemini"):
        with pytest.raises(ImportError):
            backends.backend_for(provider, o).client()


def test_options_and_devices():
    assert PageConfig(dpi=400).scale == 400 / 72 * 2
    assert workers_for(3, True, 8) == ("cuda", 6) and workers_for(9, False, 8) == ("cuda", 8)
    assert workers_for(0, True, 8) == ("mps", 4) and workers_for(0, False, 2) == ("cpu", 2) and workers_for(0, False, 16) == ("cpu", 8)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert Options(extraction_complexity=True).detailed_extraction
    assert any(issubclass(w.category, DeprecationWarning) for w in seen)
    with pytest.raises(ValueError):
        Options(extraction_complexity=True, detailed_extraction=True)
    with pytest.raises(ValueError):
        Options(image_mode="jpeg")
    assert Options(num_workers=10).workers == 10
    assert local_server_env("cpu", 4, True, {"OLLAMA_NUM_THREAD": 2}) == {"OLLAMA_KEEP_ALIVE": "-1", "OLLAMA_NUM_THREAD": "2", "OLLAMA_NUM_PARALLEL": "40"}


def test_registry(spark):
    assert registry.provider_of("gpt-4o", lambda: {"gpt-4o": "other"}) == "openai"
    assert registry.provider_of("mine", lambda: {"mine": "ollama"}) == "ollama"

    def broken():
        raise OSError

    with pytest.raises(UnsupportedModelError, match="gpt-4o"):
        registry.provider_of("mine", broken)
    asked = []

    def show(name):
        asked.append(name)
        return {"a": {"capabilities": ["vision"]}, "b": {"details": {"families": ["clip"]}}, "c": {"capabilities": "vision"}}[name]

    discover = registry.discovery(spark, lambda: ["a", "b", "c", "d", "a"], show)
    assert asked == [] and discover() == {"a": "ollama", "b": "ollama"} == discover() and asked == ["a", "b", "c", "d"]
    assert registry.vision_models(spark, broken, show) == set()


def test_figure_files_never_meet(spark, tmp_path):
    df = spark.createDataFrame([("/x/a.pdf", 0, [b"1"]), ("/y/a.pdf", 0, [b"2"])], "doc_id string, page_number int, pngs array<binary>")
    out = sinks.with_figure_files(df, "pngs", f"file://{tmp_path}").collect()
    assert len({r["figures"][0]["image_url"] for r in out}) == 2
    assert sorted(p.read_bytes() for p in tmp_path.rglob("*.png")) == [b"1", b"2"]


def test_filter_below_model_stage(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_number"), F.lit(analysis()).alias("reply"))
    routed = routing.with_routes(df, "ollama")
    assert routing.converted(routed, lambda rows: rows.withColumn("answer", F.lit("x"))).where("route = 'direct'").count() == 10


def test_regions_and_gates(spark):
    page = np.full((400, 400, 3), 255, np.uint8)
    page[30:170, 20:220] = np.linspace(30, 190, 200)[None, :, None].astype(np.uint8)
    page[220:330, 50:180] = np.linspace(60, 200, 130)[None, :, None].astype(np.uint8)
    page[350:360, 10:60] = 0
    found = figures.regions(page)
    assert [(abs(r["x"] - x) < 3, abs(r["y"] - y) < 3) for r, (x, y) in zip(found, [(20, 30), (50, 220)])] == [(True, True)] * 2 and len(found) == 2
    assert found[0]["png"].startswith(b"\x89PNG") and figures.regions(np.dstack([page, page[:, :, 0]]), False)[0]["w"] == found[0]["w"]
    for bad in (page[:, :, 0], page[:, :, :1]):
        with pytest.raises(figures.FigureError):
            figures.regions(bad)
    assert figures.regions(np.full((50, 50, 3), 255, np.uint8)) == []
    ok = {"w": 100, "h": 100, "page_w": 1000, "page_h": 1000, "std": 26.0, "mean": 100.0, "area": 5000.0, "lapvar": 499.0}
    edges = [({}, True), ({"w": 99}, False), ({"w": 950, "area": 9e5}, True), ({"w": 951, "area": 9e5}, False), ({"h": 951, "area": 9e5}, False), ({"std": 25.0}, False)]
    edges += [({"mean": 20.0}, False), ({"mean": 20.1}, True), ({"mean": 235.0}, False), ({"area": 4000.0}, False), ({"area": 4000.1}, True), ({"lapvar": 500.0}, False)]
    rows = [(i, *(ok | change).values(), want) for i, (change, want) in enumerate(edges)]
    df = spark.createDataFrame(rows, "i int, w int, h int, page_w int, page_h int, std double, mean double, area double, lapvar double, want boolean")
    assert {r["i"] for r in figures.accepted(df).collect()} == {r[0] for r in rows if r[-1]}
    ties = spark.createDataFrame([(1, 5.0, 2, 1), (1, 5.0, 1, 9), (1, 7.0, 9, 9), (2, 1.0, 0, 0)], "p int, area double, y int, x int")
    assert sorted((r["p"], r["idx"], r["y"]) for r in figures.numbered(ties, ["p"]).collect()) == [(1, 1, 9), (1, 2, 1), (1, 3, 2), (2, 1, 0)]
