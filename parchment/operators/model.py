"""Language-model calls: settings, request and answer as expressions, and the call through an injected transport."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http.client import HTTPConnection, HTTPSConnection
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPERATURE, ERROR_CHARS = 0.2, 300
CONNECT_SECONDS, READ_SECONDS = 20, 60
#: Fixed value: what an error message starts with.
ERROR = "오류: "


# Address and default model of each provider; all speak the same protocol.
PRESETS = {
    "OPENAI": ("https://api.openai.com/v1", "gpt-4o-mini"),
    "CLAUDE": ("https://api.anthropic.com/v1", "claude-sonnet-4-20250514"),
    "GEMINI": ("https://generativelanguage.googleapis.com/v1beta/openai", "gemini-2.0-flash"),
    "GROK": ("https://api.x.ai/v1", "grok-3"),
    "CUSTOM": ("", ""),
}


@dataclass(frozen=True)
class Settings:
    """A provider; the key comes from the environment and never stands in a plan."""

    base_url: str
    model: str
    key_variable: str = "PARCHMENT_MODEL_KEY"
    enabled: bool = True

    @property
    def ready(self) -> bool:
        return self.enabled and bool(os.environ.get(self.key_variable, "").strip())

    @property
    def url(self) -> str:
        return self.base_url.strip().rstrip("/") + "/chat/completions"


def settings_of(provider: str | None = None, base_url: str = "", model: str = "", enabled: bool = True) -> Settings:
    """Settings of a provider, the first one where the name is unknown; blank values are its presets, and each provider has a key of its own."""
    name = provider if provider in PRESETS else next(iter(PRESETS))
    url, default = PRESETS[name]
    own = f"PARCHMENT_MODEL_KEY_{name}"
    return Settings(base_url.strip() or url, model.strip() or default, own if os.environ.get(own, "").strip() else "PARCHMENT_MODEL_KEY", enabled)


def setting(value: Column, default: Column) -> Column:
    """Trimmed; blank is the default."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default)


def request(model: str, system: Column, user: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(TEMPERATURE).alias("temperature"), F.array(message("system", system), message("user", user)).alias("messages")))


def answer(body: Column) -> Column:
    return F.trim(F.get_json_object(body, "$.choices[0].message.content"))


def http_transport(settings: Settings) -> Callable[[str], tuple[int, str]]:
    """A transport for complete(): posts a request to a provider.  The key is read from the environment where the call is made."""
    url = urlsplit(settings.url)

    def send(body: str) -> tuple[int, str]:
        kind = HTTPSConnection if url.scheme == "https" else HTTPConnection
        link = kind(url.hostname, url.port, timeout=CONNECT_SECONDS)
        try:
            link.connect()
            link.sock.settimeout(READ_SECONDS)
            link.request("POST", url.path, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(settings.key_variable, '').strip()}"})
            answer = link.getresponse()
            return answer.status, answer.read().decode("utf-8", "replace")
        finally:
            link.close()

    return send


def complete(prompts: DataFrame, key: str, model: str, transport: Callable[[str], tuple[int, str]]) -> DataFrame:
    """(key, answer, error) of prompts (key, system, user); transport: request -> (status, body), called on the executors."""
    d = prompts.select(key, request(model, F.col("system"), F.col("user")).alias("request"))
    kind = d.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for r in p["request"]:
                try:
                    rows.append((*transport(r), None))
                except Exception as e:  # noqa: BLE001  of one call, not of the job
                    rows.append((None, None, str(e)))
            yield p[[key]].assign(**{c: [r[i] for r in rows] for i, c in enumerate(("status", "body", "failed"))})

    d = d.mapInPandas(run, f"{key} {kind}, status int, body string, failed string")
    good = F.col("status").between(200, 299)
    said = F.when(good, answer(F.col("body")))
    # Fixed value: the message of a refused request.
    refused = F.concat(F.lit("LLM 요청 실패 ("), F.col("status").cast("string"), F.lit("): "), F.left(F.coalesce("body", F.lit("")), F.lit(ERROR_CHARS)))
    error = F.when(F.col("failed").isNotNull(), F.col("failed")).when(~good, refused).when(said.isNull(), "no answer in the body")
    return d.select(key, said.alias("answer"), F.concat(F.lit(ERROR), error).alias("error"))
