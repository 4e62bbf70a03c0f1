"""``python -m slabwise.recover --recover --path PATH``: rebuilds the index of a store from its segment files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from slabwise.blobstore import recover


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="slabwise.recover", description=__doc__)
    p.add_argument("--recover", action="store_true", help="say that the index may be replaced")
    p.add_argument("--path", default="", help="folder of the store, a URI that all machines reach")
    given = p.parse_args(args)
    if not given.recover or not given.path:
        p.print_usage(sys.stderr)
        return 1
    try:
        done = recover(SparkSession.builder.appName("slabwise-recover").getOrCreate(), given.path)
    except Exception as e:  # noqa: BLE001
        print(f"recovery failed: {e}", file=sys.stderr)
        return 1
    print(", ".join(f"{k}: {v}" for k, v in done.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
