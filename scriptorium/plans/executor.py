"""The only side effects on files: applying plans (action, src, dst) that other operators made. Dry unless told otherwise."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(plan: DataFrame, dry_run: bool = True) -> dict[str, int]:
    """Counts by action. Moves, copies, deletes and writes (column content); rows of other actions are skipped.

    Targets that exist are never overwritten by moves and copies; a missing source, or a file that can't be written, counts as an
    error and does not end the run. Each partition is applied by its own task: paths must be reachable from executors, as
    on a mounted share. A task that runs again finds its targets there and skips them.
    """
    if dry_run:
        return {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}  # a row for each action
    columns = [F.col(c) if c in plan.columns else F.lit(None).cast("string").alias(c) for c in ("action", "src", "dst", "content")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"done": [_safely(*row) for row in batch.itertuples(index=False, name=None)]})

    done = plan.select(*columns).mapInPandas(run, "done string")
    return {r["done"]: r["n"] for r in done.groupBy("done").agg(F.count("*").alias("n")).collect()}


def _safely(action: str, src: str | None, dst: str | None, content: str | None) -> str:
    try:
        return _one(action, src, dst, content)
    except OSError:
        return "error"


def _one(action: str, src: str | None, dst: str | None, content: str | None) -> str:
    if action in ("move", "copy"):
        if not src or not Path(src).exists():
            return "error"
        if not dst or Path(dst).exists():
            return "skip"
        Path(dst).parent.mkdir(parents=True, exist_ok=True)
        (shutil.move if action == "move" else shutil.copy2)(src, dst)
    elif action == "delete":
        if not src or not Path(src).is_file():
            return "error"
        Path(src).unlink()
    elif action == "write":
        Path(dst).parent.mkdir(parents=True, exist_ok=True)
        Path(dst).write_text(content or "", encoding="utf-8")
    return action


def empty_directories(root: str | Path, keep: Iterable[str] = ()) -> list[Path]:
    """Directories below root without any file below them, deepest first; names in `keep` and their ancestors stay."""
    top, out, kept = Path(root), [], set(keep)
    full: set[Path] = {top}
    for p in sorted(top.rglob("*"), key=lambda p: -len(p.parts)):
        if p.is_dir():
            if p in full or p.name in kept:
                full.add(p.parent)
            else:
                out.append(p)
        else:
            full.add(p.parent)
    return out


def remove_empty_directories(root: str | Path, keep: Iterable[str] = (), dry_run: bool = True) -> int:
    found = empty_directories(root, keep)
    if not dry_run:
        for p in found:
            p.rmdir()
    return len(found)


def write_or_inline(rows: DataFrame, output: str | None = None, most: int = 10_000) -> dict:
    """Rows as a payload, or written as JSON lines with a summary. Without an output the number of rows is bounded."""
    if output is None:
        got = rows.limit(most + 1).toJSON().collect()
        if len(got) > most:
            raise ValueError(f"more than {most} rows: name an output")
        return {"rows": [json.loads(x) for x in got]}
    rows.write.mode("overwrite").json(output)
    return {"output": output, "rows": rows.sparkSession.read.schema(rows.schema).json(output).count()}


def save_section(path: str | Path, name: str, section: dict) -> dict:
    """A JSON configuration with one section replaced; others stay. Written beside and then put in place, so that it is never half there."""
    file = Path(path)
    whole = json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    whole[name] = section
    beside = file.with_name(file.name + ".new")
    beside.write_text(json.dumps(whole, ensure_ascii=False, indent=2), encoding="utf-8")
    beside.replace(file)
    return whole


def read_or_empty(path: str | Path) -> str:
    """A file's text; empty where it is missing."""
    file = Path(path)
    return file.read_text(encoding="utf-8") if file.is_file() else ""


def prompt_template(folder: str | Path, source: str, names: dict[str, str]) -> str:
    """The text of the template for a source type, or for documents if it has none of its own. Missing files are errors."""
    return (Path(folder) / names.get(source, names["document"])).read_text(encoding="utf-8")
