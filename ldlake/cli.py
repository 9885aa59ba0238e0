"""Command line: ``python -m ldlake.cli COMMAND ...``. The command may be left out where an option tells it."""

from __future__ import annotations

import argparse
import sys

from .operators.munging import MungeOptions
from .plans import commands
from .sources import writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ldlake")
    top.add_argument("--log-level", default="WARN")
    sub = top.add_subparsers(dest="command", required=True)

    m = sub.add_parser("munge-sumstats")
    m.add_argument("--sumstats", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--merge-alleles")
    for flag in ("daner", "daner-n", "keep-maf", "a1-inc", "no-alleles"):
        m.add_argument(f"--{flag}", action="store_true")
    for name, default in (("n-min", 0.0), ("maf-min", 0.01), ("info-min", 0.9), ("N", None), ("N-cas", None), ("N-con", None), ("nstudy-min", None)):
        m.add_argument(f"--{name}", type=float, default=default)
    for name in ("snp", "N-col", "N-cas-col", "N-con-col", "a1", "a2", "p", "frq", "info", "signed-sumstats", "ignore", "info-list", "nstudy"):
        m.add_argument(f"--{name}")

    l2 = sub.add_parser("l2")
    l2.add_argument("--bfile", required=True)
    l2.add_argument("--out", required=True)
    l2.add_argument("--ld-wind-cm", type=float, dest="cm")
    l2.add_argument("--ld-wind-kb", type=float, dest="kb")
    l2.add_argument("--ld-wind-snps", type=int, dest="snps")
    for name in ("annot", "cts-bin", "cts-breaks", "cts-names", "extract", "keep", "print-snps"):
        l2.add_argument(f"--{name}")
    for flag in ("thin-annot", "per-allele", "snp-level-masking", "global-pass", "python-compat", "yes-really", "no-print-annot"):
        l2.add_argument(f"--{flag}", action="store_true")
    l2.add_argument("--maf", type=float)
    l2.add_argument("--pq-exp", type=float)
    l2.add_argument("--chunk-size", type=int, default=200, dest="chunk")
    l2.add_argument("--sketch", type=int)
    l2.add_argument("--sketch-maf-aware", action="store_true")
    l2.add_argument("--fast-f32", action="store_true")
    for flag in ("mmap", "gpu", "verbose-timing", "maf-pre"):  # taken, without effect on results here
        l2.add_argument(f"--{flag}", action="store_true")

    for name in ("h2", "rg"):
        h = sub.add_parser(name)
        if name == "h2":
            h.add_argument("--h2")
            h.add_argument("--h2-cts")
            h.add_argument("--ref-ld-chr-cts")
            h.add_argument("--intercept-h2", type=float)
            h.add_argument("--frqfile")
            h.add_argument("--frqfile-chr")
            for flag in ("print-coefficients", "overlap-annot", "print-all-cts", "print-cov", "print-delete-vals", "invert-anyway", "verbose-timing"):
                h.add_argument(f"--{flag}", action="store_true")
            h.add_argument("--samp-prev", type=float)
            h.add_argument("--pop-prev", type=float)
        else:
            h.add_argument("--rg", required=True)
            h.add_argument("--intercept-h2")
            h.add_argument("--intercept-gencov")
            h.add_argument("--no-check-alleles", action="store_true")
        for opt in ("ref-ld", "ref-ld-chr", "w-ld", "w-ld-chr", "out"):
            h.add_argument(f"--{opt}")
        h.add_argument("--M", type=float)
        for flag in ("not-m-5-50", "no-intercept", "return-silly-things"):
            h.add_argument(f"--{flag}", action="store_true")
        h.add_argument("--two-step", type=float)
        h.add_argument("--chisq-max", type=float)
        h.add_argument("--n-blocks", type=int, default=200)

    a = sub.add_parser("make-annot")
    for name in ("bimfile", "annot-file"):
        a.add_argument(f"--{name}", required=True)
    for name in ("bed-file", "gene-set-file", "gene-coord-file"):
        a.add_argument(f"--{name}")
    a.add_argument("--windowsize", type=int, default=0)
    a.add_argument("--nomerge", action="store_true")

    c = sub.add_parser("cts-annot")
    for name in ("bimfile", "annot-file", "cts-bin", "cts-breaks"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--cts-names")
    return top


def with_command(args: list[str]) -> list[str]:
    """Put in the command that the options imply, if none is given."""
    if args and not args[0].startswith("-"):
        return args
    for option, command in (("--h2", "h2"), ("--h2-cts", "h2"), ("--rg", "rg"), ("--l2", "l2"), ("--sumstats", "munge-sumstats")):
        if option in args:
            return [command, *[x for x in args if x != "--l2"]]
    return args


def _list(text: str | None) -> list[float | None] | None:
    return None if text is None else [None if x.strip().upper() in ("", "N", "NA") else float(x) for x in text.split(",")]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(with_command(list(sys.argv[1:] if argv is None else argv)))
    from pyspark.sql import SparkSession

    from .plans.ship import ship

    spark = SparkSession.builder.appName("ldlake").getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    ship(spark)
    if args.command == "munge-sumstats":
        names = {
            "SNP": args.snp, "N": args.N_col, "N_CAS": args.N_cas_col, "N_CON": args.N_con_col, "A1": args.a1, "A2": args.a2, "P": args.p,
            "FRQ": args.frq, "INFO": args.info
        }
        parts = lambda x: tuple(p.strip() for p in x.split(",")) if x else ()
        opts = MungeOptions(
            args.daner, args.daner_n, args.n_min, args.maf_min, args.info_min, args.N, args.N_cas, args.N_con,
            {k: v for k, v in names.items() if v}, args.signed_sumstats, parts(args.ignore), args.keep_maf, args.a1_inc, args.no_alleles,
            parts(args.info_list), args.nstudy, args.nstudy_min
        )
        done = commands.run_munge(spark, args.sumstats, args.out, opts, args.merge_alleles)
        for name, n in commands.munge_counts(spark, args.sumstats, opts, args.merge_alleles):
            print(f"  Read {n} rows" if name == "read" else f"  Removed {n} SNPs: {name}")
        print(f"Munging complete: {done.count()} SNPs -> {args.out}.sumstats.gz")
    elif args.command == "l2":
        keys = commands.LdOptions.__dataclass_fields__
        got = commands.run_l2(spark, args.bfile, args.out, commands.LdOptions(**{k: v for k, v in vars(args).items() if k in keys}))
        print(writers.ld_summary(got["summary"].collect(), got["correlations"].collect(), got["columns"], f"{args.out}.l2.ldscore.gz"), end="")
    elif args.command in ("h2", "rg"):
        split = args.ref_ld_chr is not None
        ref, weights = args.ref_ld_chr or args.ref_ld, args.w_ld_chr or args.w_ld
        common = {
            "m": args.M, "not_m_5_50": args.not_m_5_50, "no_intercept": args.no_intercept, "two_step": args.two_step,
            "chisq_max": args.chisq_max, "n_blocks": args.n_blocks, "return_silly_things": args.return_silly_things
        }
        if args.command == "rg":
            _, text = commands.run_rg(
                spark, args.rg.split(","), ref, weights, commands.RegressionOptions(**common), split, _list(args.intercept_h2),
                _list(args.intercept_gencov), args.no_check_alleles
            )
        else:
            opts = commands.RegressionOptions(
                **common, intercept=args.intercept_h2, samp_prev=args.samp_prev, pop_prev=args.pop_prev, overlap_annot=args.overlap_annot,
                frqfile=args.frqfile, frqfile_chr=args.frqfile_chr, print_coefficients=args.print_coefficients,
                print_all_cts=args.print_all_cts
            )
            if args.h2_cts:
                _, text = commands.run_cell_types(spark, args.h2_cts, ref, weights, args.ref_ld_chr_cts, opts, args.out)
            else:
                fit, text = commands.run_h2(spark, args.h2, ref, weights, args.out, opts, split, args.w_ld_chr is not None)
                jk = (fit[0] if isinstance(fit, tuple) else fit).jackknife
                if args.print_cov:
                    text += f"Covariance of the estimates:\n{jk.cov}\n"
                if args.print_delete_vals:
                    text += f"Delete values:\n{jk.delete}\n"
        print(text, end="")
    elif args.command == "make-annot":
        commands.run_make_annot(
            spark, args.bimfile, args.annot_file, args.bed_file, args.gene_set_file, args.gene_coord_file, args.windowsize, args.nomerge
        )
    else:
        commands.run_cts_annot(
            spark, args.bimfile, args.cts_bin.split(","), args.cts_breaks, args.annot_file,
            args.cts_names.split(",") if args.cts_names else None
        )
    return 0


if __name__ == "__main__":
    sys.exit(main())
