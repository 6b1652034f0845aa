"""Generated positions resolved through source maps as a table of segments.

Each map is decoded once into (line, column, source, position, name) rows; frames meet them by an as-of join inside of
(map, line), over ranges, so neither a map's text nor its segments travel beside every frame, and neither a map that all
frames are in nor a generated file of one long line is one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.functions.sourcemap import segments
from ironsieve.functions.text import normal_path
from ironsieve.operators.components import hot_bar, join_by_key
from ironsieve.operators.prefix import carried
from ironsieve.session import cut

KEYS = ("project_id", "release", "file_path")
SEGMENTS = "project_id string, release string, file_path string, line int, column int, no long, source string, source_line int, source_column int, name string"
_CHUNK = 50_000


def decoded(content: str | None) -> Iterator[tuple]:
    """(line, column, no, source, source_line, source_column, name) of a map; lines from 1, columns from 0.

    Line 0 has the source that stands for the whole map: the first one outside of installed packages. A segment without
    source has nulls; a map that isn't one has no rows, and a broken list of segments is left out as a whole.
    """
    try:
        m = json.loads(content)
        sources = [s if isinstance(s, str) else None for s in m["sources"]]
    except (TypeError, ValueError, KeyError):
        return
    root = m.get("sourceRoot")
    root = f"{root.rstrip('/')}/" if isinstance(root, str) and root else ""
    sources = [s if s is None else root + s for s in sources]
    yield 0, 0, 0, next((s for s in sources if s and "node_modules" not in s), None), None, None, None
    mappings, names = m.get("mappings"), m.get("names") or []
    if not isinstance(mappings, str):
        return
    rows, source, line, column, name = [], 0, 0, 0, 0
    for number, row in enumerate(mappings.split(";"), 1):
        at = 0
        for text in filter(None, row.split(",")):
            try:
                s = segments(text)
            except KeyError:
                return
            at += s[0]
            told = (None, None, None, None)
            if len(s) >= 4:
                source, line, column = source + s[1], line + s[2], column + s[3]
                if len(s) > 4:
                    name += s[4]
                inside = 0 <= source < len(sources)
                told = (sources[source] if inside else None, line + 1, column, names[name] if len(s) > 4 and 0 <= name < len(names) else None)
            rows.append((number, at, len(rows) + 1, *told))
    yield from rows


def segment_table(maps: DataFrame) -> DataFrame:
    """SEGMENTS of maps (project_id, release, file_path, content), each decoded once, in Arrow batches of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in SEGMENTS.split(", ")]
        rows: list[tuple] = []
        for b in batches:
            for *key, content in b[[*KEYS, "content"]].itertuples(index=False):
                for row in decoded(content):
                    rows.append((*key, *row))
                    if len(rows) >= _CHUNK:
                        yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("source_line", "source_column")})
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("source_line", "source_column")})

    return maps.select(*KEYS, "content").mapInPandas(run, SEGMENTS)


def resolve_frames(frames: DataFrame, maps: DataFrame, ranges: int | None = None) -> DataFrame:
    """``frames`` (project_id, release, file, line, column, …) with source_file, source_line, source_column, source_name.

    A file's map is ``file.map``, else one under its own name. A frame takes the segment of its line with the greatest
    column that isn't above its own; if there is none, or it has no source outside of installed packages, or the frame
    has no column, the map's first own source and the frame's line. Without a map, the frame's own file and line. Paths
    are relative and have no way up. Null releases have no map; equal frames are resolved each; of maps with equal keys
    (there should be none) any one counts.
    """
    key = F.to_json(F.struct("project_id", "release", "file"))
    keyed = cut(frames.withColumns({"_key": key, "_row": F.monotonically_increasing_id()}))
    files = keyed.groupBy("_key", "project_id", "release", "file").agg(F.count(F.lit(1)).alias("_n"))
    named = files.select("_key", "project_id", "release", F.explode(F.array(F.concat("file", F.lit(".map")), "file")).alias("file_path"), "file")
    known = maps.select(*KEYS).distinct()
    found = named.join(known, [*KEYS]).groupBy("_key").agg(F.min_by("file_path", F.when(F.col("file_path") == F.col("file"), 1).otherwise(0)).alias("_map"))
    used = cut(files.join(found, "_key", "left"))
    wanted = used.where("_map is not null").select("project_id", "release", F.col("_map").alias("file_path")).distinct()
    table = cut(segment_table(maps.join(wanted, [*KEYS], "left_semi").dropDuplicates([*KEYS])))
    rest = table.where("line = 0").select("project_id", "release", F.col("file_path").alias("_map"), F.col("source").alias("_rest"))
    facts = used.join(rest, ["project_id", "release", "_map"], "left").select("_key", "_n", "_map", "_rest")
    met = join_by_key(keyed, facts, ["_key"], "_n", hot_bar(keyed.count()))
    # frames and segments in one order: a segment comes before the frames at its column
    seg = F.struct("source", "source_line", "source_column", "name").alias("_seg")
    left = table.where("line > 0").select(*KEYS, "line", "column", F.col("no").alias("_no"), F.lit(0).alias("_kind"), seg, F.lit(None).cast("long").alias("_row"))
    placed = met.where("_map is not null and column is not null")
    right = placed.select("project_id", "release", F.col("_map").alias("file_path"), F.col("line").cast("int"), F.col("column").cast("int"), F.lit(None).cast("long").alias("_no"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_seg"].dataType).alias("_seg"), "_row")
    hits = carried(left.unionAll(right), [*KEYS, "line"], ["column", "_kind", "_no", "_row"], {"_hit": F.col("_seg")}, ranges)
    hits = hits.where("_kind = 1").select("_row", F.col("_hit").alias("_seg"))
    every = met.join(hits, "_row", "left")
    own = F.col("_seg.source").isNotNull() & ~F.contains("_seg.source", F.lit("node_modules"))
    own = F.coalesce(own, F.lit(False))
    source = F.when(own, F.col("_seg.source")).otherwise(F.col("_rest"))
    clean = normal_path(F.translate(source, "\\", "/"))
    return every.select(
        *frames.columns,
        F.coalesce(clean, "file").alias("source_file"),
        F.when(own, F.coalesce("_seg.source_line", "line")).otherwise(F.col("line")).cast("int").alias("source_line"),
        F.when(own, F.col("_seg.source_column")).alias("source_column"),
        F.when(own, F.col("_seg.name")).alias("source_name"),
    )
