"""Print the formatted physical plan of registered queries.

usage: python tests/show_plan.py [sf_dir] ID [ID ...]
"""
from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from tunekiln.session import get_session
    spark = get_session()
    for name in args:
        print(f"===== {name} =====")
        E.queries()[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
