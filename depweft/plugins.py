"""Plug-in families, their manifests and a registry of what is installed."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.runtime import map_batches

CONTRACT = (1, 0, 0)
FAMILIES = ("vcs", "cicd", "extractor", "telemetry", "store", "llm", "intra")


class Plugin(ABC):
    """Something that yields or takes frames; ``family`` says which columns are meant."""

    family = ""
    name = ""

    def capabilities(self) -> dict[str, bool]:
        return {}


class SourcePlugin(Plugin):
    """vcs, cicd, telemetry and intra plug-ins: named frames."""

    @abstractmethod
    def frames(self, spark: SparkSession) -> dict[str, DataFrame]: ...


class ExtractorPlugin(Plugin):
    """From ``repo, path, content`` to references, declarations and identities."""

    family = "extractor"

    @abstractmethod
    def extract(self, files: DataFrame) -> dict[str, DataFrame]: ...


class StorePlugin(Plugin):
    family = "store"

    @abstractmethod
    def persist_build(self, edges: DataFrame) -> None: ...


class LlmPlugin(Plugin):
    """Fills a table of responses for ``cache_key, prompt``."""

    family = "llm"

    @abstractmethod
    def answer(self, requests: DataFrame) -> DataFrame: ...


class ChatCompletions(LlmPlugin):
    """Answers from an endpoint of the chat-completions form, asked by the tasks themselves, one request after the other.

    An answer is the JSON object that the prompt asks for; its fields become columns. Time-outs, refusals (429) and other
    faults leave the answer null and name the fault in ``error``; nothing is asked twice. The key is read from an
    environment variable of the executors, so it enters no plan.
    """

    name = "chat-completions"

    def __init__(self, endpoint: str, model: str, key_variable: str = "DEPWEFT_LLM_KEY", timeout: float = 60.0) -> None:
        self.endpoint, self.model, self.key_variable, self.timeout = endpoint.rstrip("/"), model, key_variable, timeout

    def capabilities(self) -> dict[str, bool]:
        return {"chat_completions": True, "structured_output": True}

    def ask(self, prompt: str) -> tuple[dict, str | None]:
        """(the answer's object, the fault) of one prompt."""
        body = {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(f"{self.endpoint}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                found = json.loads(json.load(reply)["choices"][0]["message"]["content"])
            return (found, None) if isinstance(found, dict) else ({}, "malformed")
        except urllib.error.HTTPError as e:
            return {}, "rate-limited" if e.code == 429 else "endpoint-error"
        except TimeoutError:
            return {}, "timeout"
        except urllib.error.URLError as e:
            return {}, "timeout" if isinstance(e.reason, TimeoutError) else "endpoint-error"
        except (ValueError, LookupError, TypeError):
            return {}, "malformed"

    def answer(self, requests: DataFrame) -> DataFrame:
        """``cache_key, decision, candidate, value, identity_class, reasoning, error`` for ``cache_key, prompt``."""
        fields = {"decision": "decision", "candidate": "candidate_id", "value": "resolved_value", "identity_class": "identity_class", "reasoning": "reasoning"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for key, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                    found, fault = self.ask(prompt or "")
                    rows.append((key, *(None if found.get(f) is None else str(found[f]) for f in fields.values()), fault))
                cols = list(zip(*rows)) or [[]] * (len(fields) + 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["cache_key", *fields, "error"])

        distinct = requests.groupBy("cache_key").agg(F.min("prompt").alias("prompt"))
        return map_batches(distinct, run, ", ".join(f"{c} string" for c in ("cache_key", *fields, "error")))


@dataclass(frozen=True)
class Manifest:
    name: str
    family: str
    contract: tuple[int, int, int]
    capabilities: dict[str, bool] = field(default_factory=dict)


def read_manifest(raw: dict) -> Manifest:
    """Checks a manifest; every fault is named."""
    faults = [f"{k} is missing" for k in ("name", "family", "contract_version") if not raw.get(k)]
    if not faults and raw["family"] not in FAMILIES:
        faults.append(f"family must be one of {', '.join(FAMILIES)}")
    parts = str(raw.get("contract_version", "")).split(".")
    if not faults and (len(parts) != 3 or not all(p.isdigit() for p in parts)):
        faults.append("contract_version must be three numbers")
    if faults:
        raise ValueError("; ".join(faults))
    return Manifest(raw["name"], raw["family"], tuple(map(int, parts)), dict(raw.get("capabilities") or {}))


def compatible(manifest: Manifest) -> bool:
    """Same major version."""
    return manifest.contract[0] == CONTRACT[0]


class Registry:
    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        if plugin.family not in FAMILIES or not plugin.name:
            raise ValueError("a plug-in needs a known family and a name")
        self._known[plugin.family, plugin.name] = plugin

    def discover(self, group: str = "depweft.plugins") -> None:
        """Installed entry points; what cannot be loaded is left out."""
        for point in entry_points(group=group):
            try:
                self.add(point.load()())
            except Exception:  # noqa: BLE001
                continue

    def get(self, family: str, name: str) -> Plugin:
        return self._known[family, name]

    def rows(self) -> list[tuple[str, str, dict[str, bool]]]:
        return sorted((f, n, p.capabilities()) for (f, n), p in self._known.items())
