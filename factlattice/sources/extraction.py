"""Extractors: what turns a document's text into items. A model is a function from text to a JSON answer;
it runs in tasks, one call per document, and its failures are rows."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Answer of an extractor: body (JSON text), prompt_tokens, completion_tokens, cost (NULL if not billed).
Answer = tuple[str, int, int, float | None]
FIELDS = "body string, prompt_tokens long, completion_tokens long, cost double, failure string"


def stub(terms: dict[str, Sequence[str]]) -> Callable[[str], Answer]:
    """A deterministic extractor: a process for each sentence that has one of its terms."""

    def answer(text: str) -> Answer:
        items = []
        for sentence in text.replace("\n", " ").split("."):
            found = sorted(p for p, words in terms.items() if any(w.lower() in sentence.lower() for w in words))
            if found:
                when = "future" if "planned" in sentence.lower() else "present"
                items.append({"Equipment": None, "Process": found, "Role": None, "Substance": None, "Implementation": when, "Location": None, "Sentence": sentence.strip()})
        body = json.dumps({"items": items})
        return body, len(text.split()), len(body.split()), None

    return answer


def inner_json(text: str) -> str:
    """The text if it is an object, else what stands from its first { to its last }."""
    text = text.strip()
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError(f"no JSON in the answer: {text[:100]}")
    return text if text.startswith("{") else text[start : end + 1]


def command(arguments: Callable[[str], Sequence[str]], timeout: float = 600) -> Callable[[str], Answer]:
    """An extractor that runs a program and reads the JSON envelope it prints: is_error, total_cost_usd, and
    the answer under structured_output or result."""

    def answer(text: str) -> Answer:
        run = subprocess.run(list(arguments(text)), capture_output=True, text=True, timeout=timeout, check=False)
        if run.returncode:
            raise ValueError(f"the program failed: {run.stderr[:200]}")
        envelope = json.loads(run.stdout)
        if envelope.get("is_error"):
            raise ValueError(f"the program reports an error: {str(envelope)[:200]}")
        cost = float(envelope["total_cost_usd"])
        if isinstance(envelope.get("structured_output"), dict):
            return json.dumps(envelope["structured_output"]), 0, 0, cost
        return inner_json(envelope.get("result") or ""), 0, 0, cost

    return answer


def completion(post: Callable[[dict], dict], model: str, system: str, max_tokens: int = 16_000) -> Callable[[str], Answer]:
    """An extractor that posts a chat request (``post`` sends the payload and returns the parsed reply). A
    reply cut short or without content is a failure."""

    def answer(text: str) -> Answer:
        reply = post({
            "model": model, "temperature": 0.0, "max_tokens": max_tokens, "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}],
        })
        choice, usage = reply["choices"][0], reply["usage"]
        if choice.get("finish_reason") == "length":
            raise ValueError(f"stopped after {usage['completion_tokens']} tokens")
        if not (choice["message"]["content"] or "").strip():
            raise ValueError("no content")
        return choice["message"]["content"], usage["prompt_tokens"], usage["completion_tokens"], None

    return answer


def extracted(documents: DataFrame, key: str, text: str, extractor: Callable[[str], Answer]) -> DataFrame:
    """key, body, tokens, cost, failure per document; a document whose call fails has the reason and no body.
    Documents that were extracted before are left out by an anti-join beforehand (see streaming.incremental)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                try:
                    rows.append((*extractor(t or ""), None))
                except Exception as e:  # noqa: BLE001  a failed call is a row, not the end of the job
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *(f.split()[0] for f in FIELDS.split(", "))])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, {FIELDS}")
