"""Print the formatted physical plan of registered queries:
``python -m basketlens.plans.explain department_popularity [sf_dir]``."""

from __future__ import annotations

import sys

from basketlens.plans.registry import load_all
from basketlens.session import build_session
from basketlens.sources.adapter import canon


def main(argv: list[str]) -> None:
    names = [a for a in argv if not a.startswith("/")] or ["department_popularity"]
    sf_dirs = [a for a in argv if a.startswith("/")]
    spark = build_session()
    c = canon(spark, sf_dirs[0] if sf_dirs else "/root/testdata/sf0.01")
    reg = load_all()
    for name in names:
        print(f"===== {name} ({reg[name].ref})")
        reg[name].build(c).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
