"""python -m proselens.cli INPUT --out sections.json: the labelled sections of a text or PDF file, as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import layout
from .session import local
from .sources import readers


def sections_of(spark: SparkSession, path: str, least: float = 0.4, max_pages: int | None = None) -> dict:
    """{"mode", "sections", "telemetry"} of one file; a file without any text is an error."""
    if path.lower().endswith(".pdf"):
        rows, errors = readers.pdf_files(spark, path, max_pages=max_pages)
        fault = errors.first()
        if fault:
            raise ValueError(fault["message"])
    else:
        rows = layout.from_text(readers.text_files(spark, path))
    if rows.isEmpty():
        raise ValueError(f"no text in {path}")
    parsed = layout.parse(rows)
    units = {}
    for u in parsed["units"].orderBy("section_id", "nth").toLocalIterator():
        units.setdefault(u["section_id"], []).append({k: v for k, v in u.asDict(recursive=True).items() if v is not None and k not in ("doc_id", "section_id", "label", "nth")})
    sections = [{"label": s["label"], "text": s["text"], "units": units.get(s["section_id"], [])} for s in parsed["sections"].orderBy("section_id").toLocalIterator()]
    t = parsed["telemetry"].withColumn("mode", F.when(F.col("confidence") >= least, "L3").otherwise("L0")).first()
    return {"mode": t["mode"], "sections": sections, "telemetry": {"heading_confidence": t["confidence"], "num_pages": t["pages"], "num_sections": t["sections"], "tables_fixed": t["tables_fixed"]}}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("--out", default="sections.json")
    parser.add_argument("--min-conf", type=float, default=0.4)
    parser.add_argument("--max-pages", type=int)
    a = parser.parse_args(args)
    got = sections_of(spark or local(2), a.input, a.min_conf, a.max_pages)
    with open(a.out, "w", encoding="utf-8") as f:
        json.dump(got, f, ensure_ascii=False, indent=2)
    print(f"{a.out}: mode {got['mode']}, {len(got['sections'])} sections")


if __name__ == "__main__":
    main()
