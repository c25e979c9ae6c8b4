"""Command line.

python -m rohspark.cli --tped a.tped --tfam a.tfam --build hg38 --error 0.001 --winsize 60
python -m rohspark.cli vcf2tped --vcf a.vcf --out a
python -m rohspark.cli features --features f.txt --roh a.roh.bed --vcf a.vcf --out counts

A run's settings and findings go to `<out>.log`, the message of one that fails to `<out>.error`.
"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys

from rohspark.config import RohConfig
from rohspark.session import get_spark


def parser() -> argparse.ArgumentParser:
    """A flag for each setting: booleans are switches, lists take several values."""
    p = argparse.ArgumentParser(prog="rohspark", description="Calls runs of homozygosity.", allow_abbrev=False)
    for f in dataclasses.fields(RohConfig):
        flag, kind = f"--{f.name.replace('_', '-')}", str(f.type)
        default = f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default
        if kind == "bool":
            p.add_argument(flag, dest=f.name, action="store_true", default=default)
        elif kind.startswith("list"):
            p.add_argument(flag, dest=f.name, nargs="+", type=int if "int" in kind else float, default=default)
        else:
            p.add_argument(flag, dest=f.name, type=int if kind.startswith("int") else float if kind.startswith("float") else str, default=default)
    p.add_argument("--threads", type=int, default=0, help="cores of a local session; 0 leaves the choice to the submitted session")
    return p


def _once(args: list[str]) -> None:
    flags = [a.split("=", 1)[0] for a in args if a.startswith("--")]
    again = sorted({f for f in flags if flags.count(f) > 1})
    if again:
        raise SystemExit(f"given more than once: {', '.join(again)}")


def _tool(args: list[str]) -> None:
    """The commands beside the calling of segments: `vcf2tped` and `features`."""
    p = argparse.ArgumentParser(prog="rohspark", allow_abbrev=False)
    kinds = p.add_subparsers(dest="kind", required=True)
    convert = kinds.add_parser("vcf2tped", help="writes a VCF as tped and tfam")
    convert.add_argument("--vcf", required=True)
    count = kinds.add_parser("features", help="counts annotated homozygotes inside and outside of segments")
    for flag in ("--features", "--roh"):
        count.add_argument(flag, required=True)
    for flag in ("--vcf", "--tped", "--tfam"):
        count.add_argument(flag)
    for q in (convert, count):
        q.add_argument("--out", required=True)
        q.add_argument("--threads", type=int, default=0)
    given = p.parse_args(args)
    from rohspark.plans import pipeline
    from rohspark.sources import sinks

    spark = get_spark(master=f"local[{given.threads}]" if given.threads > 0 else None)
    try:
        if given.kind == "vcf2tped":
            sinks.vcf_to_tped(spark, given.vcf, given.out)
        else:
            pipeline.count_features(spark, given.features, given.roh, given.out, given.vcf, given.tped, given.tfam)
    except ValueError as e:
        raise SystemExit(str(e)) from None


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    _once(args)
    if args and args[0] in ("vcf2tped", "features"):
        return _tool(args)
    given = vars(parser().parse_args(args))
    threads = given.pop("threads")
    if threads < 0:
        raise SystemExit("threads must not be negative")
    cfg = RohConfig(**given)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    try:
        cfg.check()
    except ValueError as e:
        raise SystemExit(str(e)) from None
    from rohspark.plans import pipeline
    from rohspark.sources import sinks

    spark = get_spark(master=f"local[{threads}]" if threads else None)
    try:
        pipeline.run(spark, cfg)
    except Exception as e:
        sinks.write_lines(spark, str(e).splitlines()[:50], f"{cfg.out}.error")
        raise SystemExit(str(e).splitlines()[0] if str(e) else type(e).__name__) from e


if __name__ == "__main__":
    main()
