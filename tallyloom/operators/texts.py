"""Controls of page snapshots, tagged messages, and anchored pruning of trees of text lines."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.scalars import slug
from tallyloom.session import map_batches

# Roles of controls that can be acted on.
ROLES = ("button", "checkbox", "combobox", "link", "menuitem", "option", "radio", "searchbox", "slider", "spinbutton", "switch", "tab", "textbox", "treeitem")
# Tags of a complete message, in their order.
TAGS = ("<think>", "<observation>", "<reasoning>", "<prediction>", "<rev_check>", "<reversibility>", "<undo>", "<decision>", "</think>", "<answer>")


def controls(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, depth, bid, role, name) of every interactive line ``[bid] role 'name'``."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    pattern = r"^([ \t]*)\[([^\]]+)\][ \t]+([A-Za-z_][A-Za-z0-9_-]*)[ \t]*(.*)$"
    get = lambda k: F.regexp_extract("raw", pattern, k)
    t = lines.where(F.col("raw").rlike(pattern)).select(key, "line", F.length(get(1)).alias("depth"), get(2).alias("bid"), F.lower(get(3)).alias("role"), get(4).alias("rest"))
    quoted = F.regexp_extract("rest", "'([^']*)'", 1)
    return t.where(F.col("role").isin(*ROLES)).select(key, "line", "depth", "bid", "role", F.when(F.col("rest").rlike("'[^']*'"), quoted).otherwise(F.trim("rest")).alias("name"))


def page_links(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href, name) of the anchors of pages, in order."""
    hits = F.regexp_extract_all(F.col(html), F.lit("<a href=\"([^\"]*)\">([^<]*)</a>"), F.lit(0))
    t = rows.select(key, F.posexplode(hits).alias("pos", "raw"))
    get = lambda k: F.regexp_extract("raw", "<a href=\"([^\"]*)\">([^<]*)</a>", k)
    return t.select(key, "pos", get(1).alias("href"), get(2).alias("name"))


def canonical_click(role: Column, name: Column, bid: Column) -> Column:
    cut = slug(name)
    return F.concat(F.lit("click:"), role, F.lit(":"), F.when(cut == "", bid).otherwise(cut))


def tag_errors(text: Column, tags: list[str]) -> Column:
    """Codes of tags that do not occur exactly once, and one if they stand out of order."""
    counts = [F.when(F.regexp_count(text, F.lit(re.escape(t))) != 1, F.lit(f"count:{t}")) for t in tags]
    places = [F.instr(text, t) for t in tags]
    ordered = F.lit(True)
    for a, b in zip(places, places[1:]):
        ordered = ordered & (a < b)
    there = F.lit(True)
    for p in places:
        there = there & (p > 0)
    return F.array_compact(F.array(*counts, F.when(there & ~ordered, F.lit("order"))))


def parse_call(text: str | None) -> tuple[str, list[str], str | None] | None:
    """Name, literal arguments and bid of a single call such as ``click('a12')``; None for all else."""
    try:
        tree = ast.parse((text or "").strip(), mode="eval").body
        if not isinstance(tree, ast.Call) or not isinstance(tree.func, ast.Name):
            return None
        values = [ast.literal_eval(a) for a in tree.args] + [ast.literal_eval(k.value) for k in tree.keywords]
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    bid = values[0] if values and isinstance(values[0], str) and tree.func.id in ("click", "fill", "hover", "select_option", "press", "check", "uncheck") else None
    return tree.func.id, [repr(v) for v in values], bid


def parsed_actions(rows: DataFrame, key: str, action: str) -> DataFrame:
    """(key, name, args, bid) of action texts; name is null where a text is no literal call."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_call(t) or (None, None, None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.string())], names=[key, "name", "args", "bid"])

    return map_batches(rows.select(F.col(key).cast("string").alias(key), F.col(action).cast("string")), parse, f"{key} string, name string, args array<string>, bid string")


def prune_lines(text: str, limit: int, anchors: set[str]) -> str:
    """Lines of a tree within a budget of characters: anchors with their ancestors first, then the
    first lines that still fit, in reading order, with a mark where lines are left out."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip("\t ")) for x in lines]
    chosen: set[int] = set()
    for k, line in enumerate(lines):
        m = re.match(r"[\t ]*\[([^\]]+)\]", line)
        if m and m[1] in anchors:
            chosen.add(k)
            level = depth[k]
            for up in range(k - 1, -1, -1):
                if depth[up] < level:
                    chosen.add(up)
                    level = depth[up]
                if not level:
                    break

    def render() -> str:
        out, last = [], -1
        for k in sorted(chosen):
            if k != last + 1:
                out.append("…")
            out.append(lines[k])
            last = k
        return "\n".join(out + ["…"] * (last != len(lines) - 1))

    used = sum(len(lines[k]) + 3 for k in chosen)
    for k, line in enumerate(lines):
        if k not in chosen and used + len(line) + 3 <= limit:
            chosen.add(k)
            used += len(line) + 3
    return render()


def pruned(rows: DataFrame, key: str, text: str, anchors: str, limit: int) -> DataFrame:
    """(key, pruned) for texts and arrays of anchor ids."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [prune_lines(t or "", limit, set(a or ())) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "pruned"])

    return map_batches(rows.select(F.col(key).cast("string").alias(key), text, anchors), prune, f"{key} string, pruned string")
