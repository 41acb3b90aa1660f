"""python -m brindle FOLDER [FILE] [--json] [--serve PORT]: statements from a file, the keyboard, or clients."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from brindle.server import serve, statements
from brindle.session import Session


def main() -> None:
    parser = argparse.ArgumentParser(prog="brindle", description="Statements against a database folder.")
    parser.add_argument("folder")
    parser.add_argument("file", nargs="?", help="a file of statements; without one they are read from the keyboard")
    parser.add_argument("--json", action="store_true", help="results as JSON")
    parser.add_argument("--serve", type=int, metavar="PORT", help="answer clients at this port instead")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("brindle").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.serve is not None:
        with serve(spark, args.folder, args.serve, as_json=args.json) as server:
            return server.serve_forever()
    session, held = Session(spark, args.folder), ""
    with open(args.file, encoding="utf-8") if args.file else sys.stdin as lines:
        for line in lines:
            whole, held = statements(held + line)
            for text in whole:
                print(session.shown(text, args.json), end="", flush=True)
                if session.closed:
                    return None
    return None


if __name__ == "__main__":
    main()
