"""Command line: info, tune, bench, apply, snippet, profile, retune. Exit 0: done or nothing to gain; 1: a gain of --min-improvement or more; 2: wrong use or failure."""

from __future__ import annotations

import argparse
import json
import sys

from tessera.functions.scalars import ENGINES, LEVEL_ENCODINGS, PRIORITIES, human_bytes, parse_codecs, parse_encoding


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **more):
        p = commands.add_parser(name, **more)
        p.add_argument("file")
        p.add_argument("--output", choices=("text", "json"), default="text") if name != "apply" else p.add_argument("--output", required=False)
        return p

    p = command("info")
    p.add_argument("--columns", default="")
    p = command("tune")
    p.add_argument("--engine", choices=ENGINES, default="unknown")
    p.add_argument("--priority", choices=PRIORITIES, default="balanced")
    p.add_argument("--sample-rows", type=int, default=2_000_000)
    p.add_argument("--explain", choices=("brief", "full"), default="brief")
    p.add_argument("--min-improvement", type=float, default=10.0)
    p.add_argument("--progress", action="store_true", help="tell each column on standard error")
    p = command("bench")
    p.add_argument("--column", required=True)
    p.add_argument("--encodings", default="")
    p.add_argument("--codecs", default="")
    p.add_argument("--measure", choices=("read", "write", "size", "all"), default="all")
    p = command("apply")
    p.add_argument("--engine", choices=ENGINES, default="unknown")
    p.add_argument("--priority", choices=PRIORITIES, default="balanced")
    p.add_argument("--sample-rows", type=int, default=500_000)
    p.add_argument("--in-place", action="store_true")
    p = commands.add_parser("snippet", help="code from a report's JSON text")
    p.add_argument("file")
    p.add_argument("--engine", choices=ENGINES, default="unknown")
    p = commands.add_parser("profile", help="keep a file's statistics for retune")
    p.add_argument("file")
    p.add_argument("--save", required=True)
    p.add_argument("--sample-rows", type=int, default=2_000_000)
    p = commands.add_parser("retune", help="a report from kept statistics, without a scan")
    p.add_argument("file")
    p.add_argument("--output", choices=("text", "json"), default="text")
    p.add_argument("--engine", choices=ENGINES, default="unknown")
    p.add_argument("--priority", choices=PRIORITIES, default="balanced")
    p.add_argument("--explain", choices=("brief", "full"), default="brief")
    p.add_argument("--min-improvement", type=float, default=10.0)
    return top


def info_command(spark, a) -> int:
    from tessera.sources.footer import info

    rows = [r.asDict(True) for r in info(spark, a.file, a.columns.split(",") if a.columns else None).orderBy("position").collect()]
    if a.output == "json":
        print(json.dumps(rows))
    else:
        for r in rows:
            nulls = "?" if r["total_nulls"] is None else str(r["total_nulls"])
            print(f"{r['column']:30} {r['physical']:12} {r['logical'] or '-':22} {r['codec']:12} {human_bytes(r['compressed']):>10} {r['ratio']:6.2f}x nulls {nulls} [{', '.join(r['encodings'])}] {r['min_value']} .. {r['max_value']}")
    return 0


def tune_command(spark, a) -> int:
    from tessera.report import tune

    told = (lambda i, n, name: print(f"{i} of {n}: {name}", file=sys.stderr)) if a.progress else None
    return show_report(tune(spark, a.file, a.engine, a.priority, a.sample_rows, a.explain, told=told), a)


def retune_command(spark, a) -> int:
    from tessera.report import from_saved

    return show_report(from_saved(spark, a.file, a.engine, a.priority, a.explain), a)


def profile_command(spark, a) -> int:
    from tessera.report import profiled, save
    from tessera.sources.footer import file_summary, footers

    save(profiled(spark, a.file, a.sample_rows), file_summary(footers(spark, a.file)), a.save)
    return 0


def snippet_command(spark, a) -> int:
    from tessera.plans.snippets import snippet

    with open(a.file, encoding="utf-8") as f:
        print(snippet(f.read(), a.engine))
    return 0


def show_report(report: dict, a) -> int:
    print(json.dumps(report, default=str) if a.output == "json" else report_text(report, a.explain))
    return 1 if report["size_reduction_pct"] >= a.min_improvement else 0


def leveled(codec: str, level: int | None) -> str:
    return codec if level is None else f"{codec}:{level}"


def report_text(report: dict, explain: str) -> str:
    lines = [f"{report['file']}: {report['num_rows']} rows, {report['row_groups']} row groups, {human_bytes(report['file_size'])}, codec {report['current_codec']} to {leveled(report['file_codec'], report['file_level'])}"]
    for c in report["columns"]:
        now = "+".join(e for e in c["encodings"] if e not in LEVEL_ENCODINGS)
        lines.append(f"{c['column']:30} {'★' * c['stars']:6} {now} {c['codec']} to {c['encoding']:24} {leveled(c['rec_codec'], c['rec_level']):10} {c['confidence']:7} {c['status']}: {c['detail']}")
        lines += [f"    {n['severity']}: {n['message']}" for n in c["caveats"]]
        if explain == "full":
            lines += [f"    {t['rule']:22} {t['outcome']:36} {t['actual']} ({t['threshold']})" for t in c["rule_trace"]]
    lines.append(f"expected: {report['size_reduction_pct']:.1f} % smaller, read {report['read_speedup']:.2f}x, confidence {report['overall_confidence']}")
    if advice := report["row_group_advice"]:
        lines.append(f"row groups: {advice['avg_mb']:.1f} MiB on average ({advice['min_mb']:.1f} to {advice['max_mb']:.1f}), {advice['verdict']} the {advice['from_mb']} to {advice['to_mb']} MiB that suit {report['engine']}")
    if report["sort_candidates"]:
        lines.append(f"almost sorted by: {', '.join(report['sort_candidates'])}")
    if h := report["health"]:
        lines.append(f"columns: {h['matched']} as recommended, {h['fallbacks']} fell back, {h['weak']} gain little, {h['mismatches']} differ")
    for o in report["options"]:
        lines.append(f"option {o['id']}: {o['label']}, {leveled(o['codec'], o['level'])}")
        lines += sorted({f"    {n['severity']}: {n['message']}" for n in o["caveats"]})
    return "\n".join([*lines, report["python_snippet"]])


def bench_command(spark, a) -> int:
    from tessera.operators.bench import bench
    from tessera.operators.views import with_badges

    encodings = [parse_encoding(e) for e in a.encodings.split(",") if e.strip()] or None
    rows = [r.asDict() for r in with_badges(bench(spark, a.file, a.column, encodings, parse_codecs(a.codecs) or None)).collect()]
    if a.output == "json":
        print(json.dumps(rows))
        return 0
    for r in rows:
        text = f"{r['encoding']:24} {leveled(r['codec'], r['level']):10} "
        if not r["bytes"]:
            print(text + (r["note"] or ""))
            continue
        text += f"{human_bytes(r['bytes'])} {r['ratio']:.2f}x{' ★size' if r['best_bytes'] else ''}"
        for kind in ("write", "read"):
            if a.measure in (kind, "all"):
                text += f" {kind} {r[f'{kind}_ms']:.1f} ms{f' ★{kind}' if r[f'best_{kind}_ms'] else ''}"
        print(text)
    return 0


def apply_command(spark, a) -> int:
    from tessera.sources.rewrite import rewrite

    target = a.file if a.in_place else a.output
    if not target:
        raise ValueError("--output or --in-place is needed")
    r = rewrite(spark, a.file, target, a.engine, a.priority, a.sample_rows, a.in_place)
    print(f"{target}: {r['rows']} rows, {human_bytes(r['input_bytes'])} to {human_bytes(r['output_bytes'])} ({r['reduction_pct']:.1f} %)")
    return 0


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return {"info": info_command, "tune": tune_command, "bench": bench_command, "apply": apply_command, "snippet": snippet_command, "profile": profile_command, "retune": retune_command}[a.command](spark or session(), a)
    except Exception as e:  # noqa: BLE001
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
