"""``python -m docloom [options] FILE|FOLDER``: Markdown of files; exit code 1 where any failed."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from docloom import api
from docloom.options import Options, PdfOptions, SheetOptions, WordOptions
from docloom.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("docloom", description="Converts PDF, DOCX and XLSX files to Markdown.")
    yes = lambda *names, **more: p.add_argument(*names, action="store_true", **more)
    p.add_argument("path", nargs="?", default="")
    p.add_argument("-o", "--output", default="", help="the Markdown file, for a single input")
    p.add_argument("--output-dir", default="", help="one folder for all Markdown files")
    p.add_argument("--extensions", default=",".join(files.KNOWN), help="of files in folders, separated by commas")
    yes("-r", "--recursive", help="convert what a folder holds")
    yes("--no-skip", help="number new files where Markdown exists, instead of skipping")
    yes("-v", "--verbose", help="say what became of each file")
    for name in ("keep-headers", "strip-page-numbers", "keep-blank-pages", "no-lists", "no-headings", "no-scan-mode", "no-formulas", "no-hidden", "no-formatting", "no-images", "compact"):
        yes(f"--{name}")
    return p


def options(a: argparse.Namespace) -> Options:
    return Options(
        recursive=a.recursive, extensions=tuple(x.strip() for x in a.extensions.split(",") if x.strip()), skip_existing=not a.no_skip, output_directory=a.output_dir,
        pdf=PdfOptions(
            strip_headers_footers=not a.keep_headers, strip_blank_pages=not a.keep_blank_pages, strip_page_numbers=a.strip_page_numbers, detect_lists=not a.no_lists,
            detect_headings=not a.no_headings, preserve_formatting=not a.no_formatting, images=not a.no_images, scan_mode=not a.no_scan_mode, compact=a.compact,
        ),
        docx=WordOptions(preserve_formatting=not a.no_formatting, images=not a.no_images, compact=a.compact),
        xlsx=SheetOptions(formulas=not a.no_formulas, hidden=not a.no_hidden, compact=a.compact),
    )


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    if not a.path:
        _parser().print_help()
        return 1
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    try:
        if a.output:  # a named file is written, whatever is there
            o = options(a)
            found = files.read(spark, a.path, o)
            at = found.selectExpr("doc_id").withColumns({"output_path": api.F.lit(a.output), "status": api.F.lit("new")})
            done = api.convert_files(found, o, at)
        else:
            done = api.convert(spark, a.path, options(a))
        log = done.write()
        counts = dict(log.groupBy("status").count().collect())
    except (OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if a.verbose:
        for r in log.orderBy("doc_id").toLocalIterator():
            print(r.status, files.local(r.doc_id), r.error or r.output_path or "")
    failed = sum(n for status, n in counts.items() if status not in ("converted", "skipped"))
    print(f"{counts.get('converted', 0)} converted, {counts.get('skipped', 0)} skipped, {failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
