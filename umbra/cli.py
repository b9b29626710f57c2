"""python -m umbra.cli config validate | show [--resolved] [--config FILE] [--set a.b=c]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .plans.config import ConfigError, provenance_rows, resolve_config


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="umbra")
    config = top.add_subparsers(dest="group", required=True).add_parser("config").add_subparsers(dest="command", required=True)
    for name in ("validate", "show"):
        c = config.add_parser(name)
        c.add_argument("--config", type=Path)
        c.add_argument("--set", action="append", default=[], dest="sets")
        if name == "show":
            c.add_argument("--resolved", action="store_true", help="with the source of each value")
    a = top.parse_args(argv)
    try:
        r = resolve_config(config=a.config, sets=a.sets)
    except (ConfigError, OSError) as e:
        for line in getattr(e, "lines", [f"{type(e).__name__}: the file cannot be read"]):
            print(line, file=sys.stderr)
        return 1
    for w in r.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if a.command == "validate":
        print("configuration is valid")
    else:
        rows = provenance_rows(r)
        wide = max((len(p) + len(v) for p, v, *_ in rows), default=0)
        for path, value, source, place in rows:
            line = f"{path} = {value}"
            print(f"{line:<{wide + 3}}  # {source}{' ' + place if place else ''}" if a.resolved else line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
