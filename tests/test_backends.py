"""Clients, retries, rate limits, batches and streamed answers against stubs and a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loamtext.sources import backends, corpora
from loamtext.streaming import responses

REQUEST = "request_id string, prompt string, schema string"


class Failing:
    def __init__(self, times, message="bad"):
        self.left, self.message, self.calls = times, message, []

    def complete(self, prompt, schema=None):
        self.calls.append((prompt, schema))
        if self.left:
            self.left -= 1
            raise RuntimeError(self.message)
        return f"<{prompt}>"


@pytest.mark.parametrize(
    ("message", "waits"),
    [("bad", [2, 4, 8, 16]), ("HTTP 429", [2, 10, 50, 60]), ("RESOURCE_EXHAUSTED", [2, 10, 50, 60]), ("Rate Limit hit", [2, 10, 50, 60]), ("resource_exhausted", [2, 4, 8, 16])],
)
def test_backoff(message, waits):
    slept = []
    assert backends.complete_with_retry(Failing(4, message), "p", None, 5, slept.append) == ("<p>", None, 5)
    assert slept == waits
    slept.clear()
    assert backends.complete_with_retry(Failing(9, message), "p", None, 5, slept.append) == (None, f"RuntimeError: {message}", 5)
    assert slept == waits  # none after the last attempt
    assert backends.complete_with_retry(Failing(0), "p", None, 5, slept.append) == ("<p>", None, 1)


def test_requests_run_and_failures_are_rows(spark, tmp_path):
    requests = spark.createDataFrame([("a", "one", None), ("b", "boom", None), ("c", "three", "{}")], REQUEST)
    mark = tmp_path / "closed"

    def make():
        class Client:
            def complete(self, prompt, schema=None):
                if prompt == "boom":
                    raise ValueError("no")
                return prompt + (schema or "")

            def close(self):
                mark.write_text("yes")

        return Client()

    out = {r.request_id: (r.response, r.error, r.attempts) for r in backends.run_requests(requests, make, attempts=1).collect()}
    assert out == {"a": ("one", None, 1), "b": (None, "ValueError: no", 1), "c": ("three{}", None, 1)}
    assert mark.read_text() == "yes"


def test_rate_limit_is_shared_by_the_partitions(spark):
    import time

    rate = backends.RateLimit(per_minute=600, partitions=2)
    assert rate.spacing() == pytest.approx(0.2)
    requests = spark.createDataFrame([(str(k), "p", None) for k in range(8)], REQUEST)
    began = time.monotonic()
    assert backends.run_requests(requests, backends.Empty, rate=rate).count() == 8
    assert time.monotonic() - began >= 0.2 * 2  # one of two partitions has at least four requests, three gaps


@pytest.fixture(scope="module")
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            answers = {
                "/chat": {"choices": [{"message": {"content": "  chat said \n"}}]},
                "/text": [{"generated_text": " text said"}],
                "/parts": {"candidates": [{"content": {"parts": [{"text": "parts "}, {}, {"text": "said"}]}}]},
                "/empty": {"choices": [{"message": {"content": " "}}]},
            }
            data = json.dumps(answers[self.path]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_hosted_clients(service):
    url, seen = service
    made = lambda kind, path, **kw: backends.make_backend(kind, "m", url + path, "secret", **kw)()
    assert made("Chat", "/chat", temperature=0.3, max_tokens=9).complete("hello") == "chat said"
    assert seen[-1] == ("/chat", "Bearer secret", {"model": "m", "messages": [{"role": "user", "content": "hello"}], "temperature": 0.3, "max_tokens": 9})
    assert made("text", "/text").complete("hello") == "text said"
    assert seen[-1][2] == {"inputs": "hello", "parameters": {"temperature": 0.1, "max_new_tokens": 2048, "return_full_text": False}}
    for kind in ("PARTS", "batch"):
        assert made(kind, "/parts").complete("hello", '{"type": "array"}') == "parts said"
        assert seen[-1][2]["generationConfig"] == {"temperature": 0.1, "maxOutputTokens": 2048, "responseMimeType": "application/json", "responseJsonSchema": {"type": "array"}}
    made("parts", "/parts").complete("hello")
    assert "responseMimeType" not in seen[-1][2]["generationConfig"]
    with pytest.raises(ValueError, match="empty answer"):
        made("chat", "/empty").complete("hello")


def test_factory(monkeypatch):
    for name in ("CHAT", "TEXT", "PARTS", "BATCH"):
        monkeypatch.delenv(f"LOAMTEXT_{name}_KEY", raising=False)
    with pytest.raises(ValueError, match="unknown"):
        backends.make_backend("other")
    with pytest.raises(ValueError, match="key"):
        backends.make_backend("chat")
    monkeypatch.setenv("LOAMTEXT_CHAT_KEY", "from the environment")
    assert backends.make_backend("CHAT")().key == "from the environment"
    assert backends.make_backend("Mock")().complete("x") == "[]"
    assert callable(backends.make_backend("local", "m"))


def test_memory_map_of_a_local_model():
    assert backends.memory_map({0: 16 << 30, 1: 8 << 30}) == {0: "14GiB", 1: "7GiB"}
    assert backends.memory_map({0: 16 << 30}, reserve=0.5, cpu_gb=32) == {0: "8GiB", "cpu": "32GiB"}


def fake_libraries(monkeypatch, devices):
    """Stand-ins for the two libraries of a local model, which are not installed here."""
    import sys
    import types

    class Tensor(list):
        shape = (1, 3)
        device = "cpu"

        def to(self, device):
            return self

    class Tokenizer:
        def apply_chat_template(self, chat, add_generation_prompt, return_tensors):
            made["chat"] = chat
            return Tensor()

        def decode(self, ids, skip_special_tokens):
            return f" {ids} "

    class Model:
        device = "cpu"

        def generate(self, chat, **how):
            made["generate"] = how
            return [[1, 2, 3, 4, 5]]

    made = {}
    transformers, torch = types.ModuleType("transformers"), types.ModuleType("torch")
    transformers.AutoTokenizer = types.SimpleNamespace(from_pretrained=lambda m: Tokenizer())
    transformers.AutoModelForCausalLM = types.SimpleNamespace(from_pretrained=lambda m, **how: made.update(load=how) or Model())
    transformers.BitsAndBytesConfig = lambda **kw: kw
    memory = types.SimpleNamespace(total_memory=10 << 30)
    torch.cuda = types.SimpleNamespace(device_count=lambda: devices, get_device_properties=lambda k: memory, is_available=lambda: devices > 0, empty_cache=lambda: made.update(emptied=True))
    monkeypatch.setitem(sys.modules, "transformers", transformers)
    monkeypatch.setitem(sys.modules, "torch", torch)
    return made


def test_local_model(monkeypatch):
    made = fake_libraries(monkeypatch, 2)
    model = backends.make_backend("local", "m", bits=4, max_tokens=6)()
    assert made["load"]["quantization_config"] == {"load_in_4bit": True} and made["load"]["max_memory"] == {0: "9GiB", 1: "9GiB"}
    assert model.complete("hello") == "[4, 5]"
    assert made["chat"] == [{"role": "user", "content": "hello"}] and made["generate"] == {"max_new_tokens": 6, "do_sample": True, "temperature": 0.1}
    model.close()
    assert model.model is None and made["emptied"]
    made = fake_libraries(monkeypatch, 0)
    plain = backends.LocalModel("m", temperature=0)
    assert "quantization_config" not in made["load"] and "max_memory" not in made["load"]
    plain.complete("x")
    assert made["generate"] == {"max_new_tokens": 4096, "do_sample": False}
    with pytest.raises(ValueError):
        backends.LocalModel("m", bits=3)


def test_batches(spark, tmp_path):
    jobs = {}

    def submit(path):
        jobs["job1"] = path
        return "job1"

    states = iter([("JobState.running", None), ("JOB_STATE.SUCCEEDED", str(tmp_path / "answers")), ("done", str(tmp_path / "answers"))])
    batch = backends.Batch(spark, str(tmp_path / "queue"), "m", submit, lambda job: next(states))
    with pytest.raises(ValueError):
        batch.flush()
    batch.queue(spark.createDataFrame([("a", "one", None)], REQUEST))
    batch.queue(spark.createDataFrame([("b", "two", "{}")], REQUEST))
    assert batch.flush() == "job1" and batch.queued is None
    sent = [json.loads(r.value) for r in spark.read.text(jobs["job1"]).collect()]
    assert {x["custom_id"] for x in sent} == {"a", "b"} and {x["request"]["model"] for x in sent} == {"models/m"}
    assert batch.status("job1") == "RUNNING"
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "part.jsonl").write_text('{"custom_id": "a", "response": "[]"}\n{"custom_id": "b", "error": "x"}\n')
    assert batch.status("job1") == "SUCCEEDED"
    assert {tuple(r) for r in batch.download("job1").collect()} == {("a", "[]", None), ("b", None, "x")}
    early = backends.Batch(spark, str(tmp_path), "m", submit, lambda job: ("PENDING", None))
    with pytest.raises(ValueError, match="PENDING"):
        early.download("job1")


def test_streamed_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"custom_id": "a", "response": "[]"}\nbroken\n{"custom_id": "other", "response": "x"}\n')
    requests = spark.createDataFrame([("a", "one", None), ("b", "two", None)], REQUEST)
    run = lambda: responses.collect_answers(responses.answer_stream(spark, str(tmp_path / "in")), requests, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "[]", None)]
    (tmp_path / "in" / "2.jsonl").write_text('{"custom_id": "b", "response": "late"}\n')
    run()  # goes on from where it stopped
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "[]", None), ("b", "late", None)]
    assert corpora.ANSWER.startswith("custom_id")
