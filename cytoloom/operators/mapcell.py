"""A user's function over the files of each cell, as a Python callable or an external script."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from cytoloom.schemas import CELL_FILES

# Fixed values of the script protocol; a name may stand before the API's version line.
API, DONE, CHECKED = "mapcell-api 1.0", "MAPCELL-OK", "MAPCELL-CHECK"
LOG = "_mapcell.log"

Files = dict[str, bytes]


@dataclass(frozen=True)
class CellFunction:
    """``run`` takes a cell's files by name and returns new files and a log.

    Where one of ``expects`` is missing, ``missing`` says whether to run anyway (ignore), to pass the cell over (skip) or to fail.
    """

    run: Callable[[Files], tuple[Files, str]]
    expects: tuple[str, ...] = ()
    missing: str = "skip"


def map_cells(files: DataFrame, function: CellFunction) -> DataFrame:
    """(cell_id, file_name, content) of what the function made of each cell, with its log as one more file."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf["cell_id"].iloc[0]
        held = {n: bytes(c) for n, c in zip(pdf["file_name"], pdf["content"])}
        absent = [n for n in function.expects if n not in held]
        if absent and function.missing == "fail":
            raise ValueError(f"cell {cell} lacks {absent}")
        if absent and function.missing == "skip":
            return pd.DataFrame({"cell_id": [cell], "file_name": [LOG], "content": [f"skipped: lacks {', '.join(absent)}".encode()]})
        made, log = function.run(held)
        return pd.DataFrame({"cell_id": cell, "file_name": [*made, LOG], "content": [*made.values(), log.encode()]})

    return files.groupBy("cell_id").applyInPandas(each, CELL_FILES)


def map_batches(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Rows through an outside aligner or classifier: a function from an iterator of Arrow batches to another."""
    return rows.mapInArrow(function, schema)


def _call(script: str, *args: str) -> list[str]:
    return subprocess.run([script, *args], capture_output=True, text=True, check=True).stdout.split("\n")


def script_function(script: str, threads: int = 1) -> CellFunction:
    """A script that speaks the protocol: it names its API, says what it expects, and ends its output with MAPCELL-OK."""
    if API not in _call(script, "--mapcell-api")[0]:
        raise ValueError(f"{script} does not speak {API}")
    if CHECKED not in _call(script, "--preflight-check"):
        raise ValueError(f"{script} is not ready")
    expects = tuple(x for x in _call(script, "--expect-files")[0].split(",") if x)
    missing = _call(script, "--missing-file-mode")[0].strip() or "skip"

    def run(held: Files) -> tuple[Files, str]:
        with tempfile.TemporaryDirectory() as work:
            source, target = Path(work, "in"), Path(work, "out")
            for d in (source, target):
                d.mkdir()
            for name, content in held.items():
                (source / name).write_bytes(content)
            done = subprocess.run([script, "--input-dir", str(source), "--output-dir", str(target), "--num-threads", str(threads)], capture_output=True, text=True)
            if not done.stdout.rstrip().endswith(DONE):
                return {}, f"failed: {done.stdout}{done.stderr}"
            return {p.name: p.read_bytes() for p in sorted(target.iterdir())}, done.stdout

    return CellFunction(run, expects, missing)


def minhash_function(k: int = 31, n: int = 1000) -> CellFunction:
    """The built-in preset: the n least k-mers by a hash from r1.fq and r2.fq as minhash.txt."""
    import heapq

    import xxhash

    def run(held: Files) -> tuple[Files, str]:
        reads = [line for name in ("r1.fq", "r2.fq") for line in held.get(name, b"").split(b"\n")[1::4]]
        windows = (r[i : i + k] for r in reads for i in range(len(r) - k + 1))
        least = heapq.nsmallest(n, windows, key=lambda w: (xxhash.xxh64_intdigest(w), w))
        return {"minhash.txt": b"\n".join(sorted(least))}, f"{len(reads)} reads"

    return CellFunction(run, (), "ignore")


PRESETS: dict[str, Callable[..., CellFunction]] = {"minhash_fq": minhash_function}
