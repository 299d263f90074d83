"""python -m cambium list | run QUERY SF_DIR [OUT]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from cambium import catalog


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(f"{name}{' (oracle)' if name in catalog.ORACLES else ''}" for name in sorted(catalog.QUERIES)))
        return 0
    if args[:1] != ["run"] or len(args) not in (3, 4) or args[1] not in catalog.QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    out = catalog.QUERIES[args[1]](SparkSession.builder.appName(args[1]).getOrCreate(), args[2])
    if len(args) == 4:
        out.write.mode("overwrite").parquet(args[3])
    else:
        out.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
