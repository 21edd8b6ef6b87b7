"""Calls to what lies outside of Spark: renderers of code and generators of text.

Both are small interfaces; the library brings deterministic stubs, and a renderer that
runs a TeX engine without shell escape where one is installed. Calls run in Arrow
batches, a bounded number at once, with retries; what a call raises becomes a status.
Calls may be repeated when an executor is lost, so results are keyed by id.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship


class Renderer(Protocol):
    def render(self, code: str) -> bytes:
        """An image of the code; raises with a message if there is none."""


class Generator(Protocol):
    def generate(self, prompt: str) -> str:
        """The answer to a prompt."""


class StubRenderer:
    """Accepts code that opens and closes a document and gives a small deterministic PNG header."""

    def render(self, code: str) -> bytes:
        if "\\begin{document}" not in code or "\\end{document}" not in code:
            raise RuntimeError("! Missing document")
        size = 32 + int(hashlib.md5(code.encode()).hexdigest()[:2], 16)
        return bytes.fromhex("89504E470D0A1A0A0000000D49484452") + size.to_bytes(4, "big") * 2


class StubGenerator:
    """Answers with the last fence of the prompt, completed to a document."""

    def generate(self, prompt: str) -> str:
        code = prompt.rpartition("<CODE_START>\n")[2].partition("\n<CODE_END>")[0].strip("`\n")
        whole = code if "\\documentclass" in code else "\\documentclass{standalone}\n\\begin{document}\n" + code + "\n\\end{document}"
        return f"```latex\n{whole}\n```"


def checked(models: list[str] | None, model: str | None = None, **needed: str | None) -> str:
    """The model to ask, before anything is asked: raises ValueError where a needed setting is empty, no model is there, or ``model`` isn't among them."""
    absent = [k for k, v in needed.items() if not v]
    if absent:
        raise ValueError(f"missing settings: {', '.join(absent)}")
    if not models:
        raise ValueError("no model is served")
    if model and model not in models:
        raise ValueError(f"unknown model {model!r}; served: {', '.join(models)}")
    return model or models[0]


class Lazy:
    """Makes a renderer or generator once in each Python worker, when it is first called; only how to make it is sent."""

    _made: dict[str, object] = {}

    def __init__(self, make, name: str):
        self.make, self.name = make, name

    def _own(self):
        if self.name not in Lazy._made:
            Lazy._made[self.name] = self.make()
        return Lazy._made[self.name]

    def render(self, code: str) -> bytes:
        return self._own().render(code)

    def generate(self, prompt: str) -> str:
        return self._own().generate(prompt)


def executable(name: str, given: str | None = None, variable: str | None = None, places: tuple[str, ...] = ()) -> str | None:
    """The first that exists: the given path, the one in a variable, the one on PATH, or one of ``places``."""
    tries = [given, os.environ.get(variable) if variable else None, shutil.which(name), *places]
    return next((t for t in tries if t and os.access(t, os.X_OK)), None)


class TexRenderer:
    """Runs a TeX engine in a folder of its own, without shell escape and with a time limit."""

    def __init__(self, engine: str = "pdflatex", seconds: int = 20, density: int = 300, margin: int = 10):
        self.engine, self.seconds, self.density, self.margin = engine, seconds, density, margin

    def render(self, code: str) -> bytes:
        program, convert = executable(self.engine), executable("convert")
        if program is None:
            raise RuntimeError(f"{self.engine} isn't installed")
        if convert is None:
            raise RuntimeError("convert isn't installed")
        with tempfile.TemporaryDirectory() as folder:
            (Path(folder) / "x.tex").write_text(code, encoding="utf-8")
            env = {k: v for k, v in os.environ.items() if k in ("PATH", "HOME", "LANG")} | {"TEXMFVAR": folder, "openin_any": "p", "openout_any": "p"}
            try:
                run = subprocess.run([program, "-no-shell-escape", "-interaction=nonstopmode", "-halt-on-error", "x.tex"], cwd=folder, env=env, capture_output=True, timeout=self.seconds, check=False)
                log, failed = run.stdout.decode("latin-1") + "\n" + run.stderr.decode("latin-1"), run.returncode != 0
            except subprocess.TimeoutExpired as e:
                log, failed = (e.stdout or b"").decode("latin-1") + f"\n[TIMEOUT] {self.engine} exceeded {self.seconds}s", True
            if failed or not (Path(folder) / "x.pdf").exists():
                raise RuntimeError(errors_of(log))
            return self.image(folder, convert)

    def image(self, folder: str, convert: str) -> bytes:
        """The first page of ``x.pdf``, cropped by pdfcrop where it works, else by its white border, as PNG."""
        crop, source, border = executable("pdfcrop"), "x.pdf", []
        if crop and subprocess.run([crop, "--margins", str(self.margin), "x.pdf", "y.pdf"], cwd=folder, capture_output=True, timeout=300, check=False).returncode == 0:
            source = "y.pdf"
        else:
            border = ["-fuzz", "1%", "-trim", "+repage", "-bordercolor", "white", "-border", str(round(self.density * self.margin / 72))]
        run = subprocess.run([convert, "-density", str(self.density), f"{source}[0]", "-background", "white", "-flatten", *border, "-quality", "95", "x.png"], cwd=folder, capture_output=True, timeout=self.seconds, check=False)
        made = Path(folder) / "x.png"
        if run.returncode or not made.exists():
            raise RuntimeError(run.stderr.decode(errors="replace")[-2000:])
        return made.read_bytes()


def errors_of(log: str, last: int = 20, most: int = 3000) -> str:
    """The lines of a log that begin like errors, else its last ones; cut at ``most`` characters."""
    lines = log.splitlines()
    told = [x for x in lines if x.strip().startswith(("!", "l.", "L.", "[TIMEOUT]"))] or lines[-last:]
    text = "\n".join(told)
    return text if len(text) <= most else text[:most] + "\n...[log truncated]"


#: Rows that are handed on together: images of a batch need not all be held.
_AT_ONCE = 256


def slices(part: pd.DataFrame, most: int = _AT_ONCE) -> Iterator[pd.DataFrame]:
    """``part`` in order, ``most`` rows at once."""
    return (part.iloc[start : start + most] for start in range(0, len(part), most))


def rendered(df: DataFrame, renderer: Renderer, key: str = "id", code: str = "code") -> DataFrame:
    """``key``, ``code``, ``image`` (null on failure) and ``error`` (null on success)."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in slices(part):
                rows = []
                for k, c in zip(some[key], some[code], strict=True):
                    try:
                        rows.append((k, c, renderer.render(c or ""), None))
                    except Exception as e:  # the sample's fault becomes its status
                        rows.append((k, c, None, str(e)))
                yield pd.DataFrame(rows, columns=[key, "code", "image", "error"])

    return df.select(key, code).mapInPandas(run, f"`{key}` {kind}, code string, image binary, error string")


def waits(tries: int, first: float = 2.0, factor: float = 1.8, most: float = 20.0) -> list[float]:
    """Seconds to wait after each failed try but the last."""
    return [min(first * factor**k, most) for k in range(tries - 1)]


def generated(df: DataFrame, generator: Generator, prompt: str = "prompt", key: str = "id", at_once: int = 8, retries: int = 3, wait: float = 2.0, factor: float = 1.8, most: float = 20.0) -> DataFrame:
    """``key``, ``output`` and ``error``: the answers, asked ``at_once`` a task, each up to ``retries`` times with the :func:`waits` of ``wait``, ``factor`` and ``most`` between."""
    if at_once < 1 or retries < 1:
        raise ValueError("at_once and retries must be 1 or more")
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def ask(text: str) -> tuple[str | None, str | None]:
        error = None
        for pause in [*waits(retries, wait, factor, most), 0.0]:
            try:
                out = generator.generate(text)
                if out:
                    return out, None
                error = "empty answer"
            except Exception as e:  # any failure of the call is retried, then told
                error = str(e)[:200]
            time.sleep(pause)
        return None, f"api_error: {error}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                answers = list(pool.map(ask, part[prompt].fillna("")))
                yield pd.DataFrame({key: part[key], "output": [a for a, _ in answers], "error": [e for _, e in answers]})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, output string, error string")


def once(df: DataFrame, keys: list[str], call) -> DataFrame:
    """``call`` on the different values of ``keys`` only, joined back to every row.

    Values are found equal and joined by two hashes, so the texts that repeat aren't shuffled with every row.
    """
    told = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]  # a hash leaves nulls out
    marks = {"_mark": F.xxhash64(*told), "_mark2": F.xxhash64(F.lit(1), *told)}
    marked = df.withColumns(marks)
    few = marked.groupBy(*marks).agg(*[F.first(k).alias(k) for k in keys]).select(*keys)
    out = call(few)
    out = out.select(*[m.alias(f"_of{name}") for name, m in marks.items()], *[c for c in out.columns if c not in keys])
    return marked.join(out, (F.col("_mark") == F.col("_of_mark")) & (F.col("_mark2") == F.col("_of_mark2"))).drop(*marks, *[f"_of{name}" for name in marks])
