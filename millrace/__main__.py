"""python -m millrace: the ten operations on drawings.

    tools                                the operations and their arguments, as JSON
    PATH inspect                         counts of every drawing under PATH
    PATH drawings                        the ids of the drawings under PATH
    PATH DRAWING OPERATION [JSON]        one operation; its status, then the rows of each section. --compact: only the columns a reader needs.
                                         --evidence: its rows as they are cited, in words
"""

from __future__ import annotations

import json
import sys


def main(argv: list[str]) -> int:
    from millrace.plans.service import ARGUMENTS, Service, kind_name

    flags = {a for a in argv if a.startswith("--")}
    argv = [a for a in argv if a not in flags]
    if argv == ["tools"] and not flags:
        print(json.dumps({tool: {name: {"type": kind_name(kind), "required": required} for name, (kind, required) in arguments.items()} for tool, arguments in ARGUMENTS.items()}, indent=1))
        return 0
    listing = len(argv) == 2 and argv[1] in ("inspect", "drawings") and not flags
    if not listing and (len(argv) not in (3, 4) or flags - {"--compact", "--evidence"}):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from millrace.operators import evidence, submission
    from millrace.sources import drawings

    spark = SparkSession.builder.getOrCreate()
    objects = drawings.read_drawings(spark, argv[0])
    plant = drawings.normalize(objects)
    if listing:
        found = drawings.ingestion_matrix(objects, plant) if argv[1] == "inspect" else plant.entities.select("drawing_id").distinct().orderBy("drawing_id")
        for row in found.toJSON().toLocalIterator():
            print(row)
        return 0
    if plant.entities.where(plant.entities["drawing_id"] == argv[1]).isEmpty():
        print(f"no drawing {argv[1]!r}; `drawings` lists them", file=sys.stderr)
        return 1
    service = Service(plant, argv[1])
    result = service.call(argv[2], argv[3] if len(argv) == 4 else "{}")
    print(json.dumps({"tool": result.tool, "status": result.status, "message": result.message, "warnings": result.warnings, "meta": result.meta}))
    if result.status == "error":
        return 1
    if "--evidence" in flags:
        sections = {"evidence": evidence.of(result, service, argv[1], 1).rows.select("ref", "text").orderBy("ref")}
    else:
        sections = submission.compact(result.sections, result.tool) if "--compact" in flags else result.sections
    for name, section in sections.items():
        print(name)
        for row in section.toJSON().toLocalIterator():
            print(" ", row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
