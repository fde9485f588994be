"""The boundary to a language model: requests in, responses out.

A backend completes prompts one partition at a time (``mapInPandas``); failures become
rows, never a failed job.  Recorded responses are the default: a join.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = "request_id string, response string, error string, attempts int"


class Backend(Protocol):
    """What a client offers: text for a prompt, or an exception."""

    def complete(self, prompt: str, schema: str | None = None) -> str: ...


#: What a rate limit's message holds, the base delay, its growth and the longest delay in seconds.
LIMIT_WORDS = ("429", "RESOURCE_EXHAUSTED")
LIMIT_WORDS_ANY_CASE = ("rate limit",)
BASE_DELAY, GROWTH, LIMIT_GROWTH, LONGEST_DELAY = 2.0, 2, 5, 60.0


def backoff(attempt: int, message: str, base: float = BASE_DELAY) -> float:
    """Seconds to wait after failed attempt ``attempt`` (from 0); longer if a rate limit speaks."""
    limited = any(w in message for w in LIMIT_WORDS) or any(w in message.lower() for w in LIMIT_WORDS_ANY_CASE)
    return min(base * LIMIT_GROWTH**attempt, LONGEST_DELAY) if limited else base * GROWTH**attempt


def complete_with_retry(backend: Backend, prompt: str, schema: str | None, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """``response, error, attempts``; the last error is kept as a value."""
    for k in range(attempts):
        try:
            return backend.complete(prompt, schema), None, k + 1
        except Exception as e:  # any client error is a row
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                sleep(backoff(k, str(e)))
    return None, error if attempts else "no attempt", attempts


@dataclass(frozen=True)
class RateLimit:
    """Requests a minute over all partitions; each partition takes its share."""

    per_minute: float
    partitions: int

    def spacing(self) -> float:
        return 60.0 * self.partitions / self.per_minute


def run_requests(requests: DataFrame, make: Callable[[], Backend], attempts: int = 5, rate: RateLimit | None = None) -> DataFrame:
    """Responses for ``request_id, prompt, schema``; ``make`` builds a client in each task."""
    spacing = rate.spacing() if rate else 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, last = make(), 0.0
        try:
            for frame in frames:
                rows = []
                for request_id, prompt, schema in frame.itertuples(index=False):
                    wait = last + spacing - time.monotonic()
                    if spacing and wait > 0:
                        time.sleep(wait)
                    last = time.monotonic()
                    rows.append((request_id, *complete_with_retry(backend, prompt, schema, attempts)))
                yield pd.DataFrame(rows, columns=["request_id", "response", "error", "attempts"])
        finally:
            getattr(backend, "close", lambda: None)()

    source = requests.repartition(rate.partitions) if rate else requests
    return source.select("request_id", "prompt", "schema").mapInPandas(run, RESPONSE)


def recorded(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses from a table ``request_id, response``; a missing one is an error row."""
    joined = requests.select("request_id").join(responses.select("request_id", "response"), "request_id", "left")
    return joined.select("request_id", "response", F.when(F.col("response").isNull(), "no recorded response").alias("error"), F.lit(1).alias("attempts"))


class Empty:
    """Always the empty array."""

    def complete(self, prompt: str, schema: str | None = None) -> str:
        return "[]"


def _key(name: str, given: str | None) -> str:
    found = given or os.environ.get(name)
    if not found:
        raise ValueError(f"an API key is required: give it or set {name}")
    return found


class HttpJson:
    """A hosted model behind an HTTP JSON interface, for chat, text and batch services.

    ``payload`` makes the body from model, prompt, schema and settings; ``read`` takes
    the text out of the answer.  Empty answers are errors.
    """

    def __init__(self, url: str, model: str, key: str, payload: Callable[..., dict], read: Callable[[dict], str], temperature: float = 0.1, max_tokens: int = 2048, timeout: float = 120.0):
        self.url, self.model, self.key, self.payload, self.read = url, model, key, payload, read
        self.temperature, self.max_tokens, self.timeout = temperature, max_tokens, timeout

    def complete(self, prompt: str, schema: str | None = None) -> str:
        import json
        import urllib.request

        body = self.payload(self.model, prompt, schema, self.temperature, self.max_tokens)
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            text = self.read(json.load(answer)).strip()
        if not text:
            raise ValueError("empty answer")
        return text


def chat_payload(model: str, prompt: str, schema: str | None, temperature: float, max_tokens: int) -> dict:
    return {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}


def chat_text(answer: dict) -> str:
    return answer["choices"][0]["message"]["content"] or ""


def text_payload(model: str, prompt: str, schema: str | None, temperature: float, max_tokens: int) -> dict:
    return {"inputs": prompt, "parameters": {"temperature": temperature, "max_new_tokens": max_tokens, "return_full_text": False}}


def text_text(answer) -> str:
    return (answer[0] if isinstance(answer, list) else answer).get("generated_text", "")


def parts_payload(model: str, prompt: str, schema: str | None, temperature: float, max_tokens: int) -> dict:
    import json

    config = {"temperature": temperature, "maxOutputTokens": max_tokens}
    if schema:
        config |= {"responseMimeType": "application/json", "responseJsonSchema": json.loads(schema)}
    return {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": config}


def parts_text(answer: dict) -> str:
    return "".join(p.get("text", "") for p in answer["candidates"][0]["content"]["parts"])


def memory_map(devices: dict[int, int], reserve: float = 0.1, cpu_gb: int | None = None) -> dict:
    """Memory by device number for loading a model over several: total bytes less a reserve, in whole GiB."""
    found: dict = {k: f"{int(total * (1 - reserve)) >> 30}GiB" for k, total in devices.items()}
    return found | ({"cpu": f"{cpu_gb}GiB"} if cpu_gb else {})


class LocalModel:
    """A local transformers model, loaded once per task; needs that library on the executors.

    ``bits`` (4 or 8) quantizes the weights; with several devices the model is spread over
    them by :func:`memory_map`; :meth:`close` gives the memory back.
    """

    def __init__(self, model: str, temperature: float = 0.1, max_tokens: int = 4096, bits: int | None = None, cpu_gb: int | None = None):
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer  # not part of the base installation

        if bits not in (None, 4, 8):
            raise ValueError("weights are quantized to 4 or 8 bits")
        how: dict = {"device_map": "auto", "torch_dtype": "auto"}
        if bits:
            from transformers import BitsAndBytesConfig

            how["quantization_config"] = BitsAndBytesConfig(**{f"load_in_{bits}bit": True})
        if torch.cuda.device_count() > 1:
            how["max_memory"] = memory_map({k: torch.cuda.get_device_properties(k).total_memory for k in range(torch.cuda.device_count())}, cpu_gb=cpu_gb)
        self.tokenizer = AutoTokenizer.from_pretrained(model)
        self.model = AutoModelForCausalLM.from_pretrained(model, **how)
        self.temperature, self.max_tokens = temperature, max_tokens

    def close(self) -> None:
        import gc

        import torch

        self.model = self.tokenizer = None
        gc.collect()
        if torch.cuda.is_available():
            torch.cuda.empty_cache()

    def complete(self, prompt: str, schema: str | None = None) -> str:
        chat = self.tokenizer.apply_chat_template([{"role": "user", "content": prompt}], add_generation_prompt=True, return_tensors="pt").to(self.model.device)
        sampled = {"temperature": self.temperature} if self.temperature > 0 else {}
        out = self.model.generate(chat, max_new_tokens=self.max_tokens, do_sample=self.temperature > 0, **sampled)
        return self.tokenizer.decode(out[0][chat.shape[1] :], skip_special_tokens=True).strip()


#: Kinds of backend; each takes model, url, key and settings, and gives a maker for run_requests.
KINDS = ("mock", "chat", "text", "parts", "batch", "local")


def make_backend(kind: str, model: str = "", url: str = "", key: str | None = None, **settings) -> Callable[[], Backend]:
    """A maker of clients by name, in any case; ValueError for an unknown one or a missing key."""
    name = kind.lower()
    if name == "mock":
        return Empty
    if name == "local":
        return lambda: LocalModel(model, **settings)
    forms = {"chat": (chat_payload, chat_text), "text": (text_payload, text_text), "parts": (parts_payload, parts_text), "batch": (parts_payload, parts_text)}
    if name not in forms:
        raise ValueError(f"unknown backend {kind!r}; known: {', '.join(KINDS)}")
    secret = _key(f"LOAMTEXT_{name.upper()}_KEY", key)
    return lambda: HttpJson(url, model, secret, *forms[name], **settings)


class Batch:
    """Asynchronous batches over a shared folder: queue, submit, poll, download.

    ``submit(path)`` hands a folder of JSON lines to the service and returns a job's
    name; ``poll(job)`` returns its state and, when done, the folder of answers.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str, submit: Callable[[str], str], poll: Callable[[str], tuple[str, str | None]]):
        self.spark, self.folder, self.model, self.submit, self.poll = spark, folder.rstrip("/"), model, submit, poll
        self.queued: DataFrame | None = None

    def queue(self, requests: DataFrame) -> None:
        self.queued = requests if self.queued is None else self.queued.unionByName(requests)

    def flush(self, name: str = "batch") -> str:
        from loamtext.sources.corpora import write_requests

        if self.queued is None:
            raise ValueError("no requests")
        path = f"{self.folder}/{name}-{int(time.time() * 1000)}"
        write_requests(self.queued, path, self.model)
        self.queued = None
        return self.submit(path)

    def status(self, job: str) -> str:
        return self.poll(job)[0].rsplit(".", 1)[-1].upper()

    def download(self, job: str) -> DataFrame:
        from loamtext.sources.corpora import read_answers

        state, path = self.poll(job)
        if path is None:
            raise ValueError(f"job {job} has no answers yet: {state}")
        return read_answers(self.spark, path)
