"""Command line: `python -m tessella.cli FORMAT ACTION ...`.

    cpk list FILE | extract FILE OUT | pack DIR OUT      spc list | extract | pack likewise
    stx dump|build IN OUT    dat dump|build    wrd dump|build    spft dump|build
    wrd dialogue FILE        srd inspect FILE  roundtrip FILE...
    translate apply --patch P... --cpk C... --out DIR [--mode repack|extract] [--on-drift warn|skip|error] [--report F] [--threads N]
    translate validate --patch P... --cpk C...           (exit 1 on drift or missing targets)
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .codecs import archive, dat, font, text, utf
from .codecs.binary import Malformed
from .sources import exchange
from .sources.files import inside

FORMS = {
    "stx": (text.read_stx, text.write_stx, exchange.stx_to_json, exchange.stx_from_json),
    "dat": (dat.read_dat, dat.write_dat, exchange.dat_to_json, exchange.dat_from_json),
    "wrd": (text.read_wrd, text.write_wrd, exchange.wrd_to_json, exchange.wrd_from_json),
    "spft": (font.read_spft, font.write_spft, exchange.spft_to_json, exchange.spft_from_json),
}
CODECS = {k: v[:2] for k, v in FORMS.items()} | {"spc": (archive.read_spc, archive.write_spc), "cpk": (utf.read_cpk, utf.write_cpk), "srd": (font.read_srd, font.write_srd), "utf": (utf.read_utf, utf.write_utf)}


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _write(path: str, content: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def kind_of(path: str, data: bytes) -> str:
    """Format of a file by its extension, and by its first bytes where that is shared or missing."""
    ext = path.rsplit(".", 1)[-1].lower()
    magics = {b"STXT": "stx", b"SpFt": "spft", b"CPS.": "spc", b"CPK ": "cpk", b"@UTF": "utf", b"$CFH": "srd"}
    if ext == "stx":
        return magics.get(data[:4], "srd")
    if ext in CODECS:
        return ext
    if data[:4] in magics:
        return magics[data[:4]]
    raise Malformed(0, f"no known format: {path}")


def round_trip(path: str) -> tuple[bool, int | None]:
    """Whether parsing and writing a file gives the same bytes, and the first that differs."""
    data = _read(path)
    read, write = CODECS[kind_of(path, data)]
    back = write(read(data))
    if back == data:
        return True, None
    return False, next((i for i, (a, b) in enumerate(zip(data, back)) if a != b), min(len(data), len(back)))


def _cpk(args) -> None:
    if args.action == "list":
        a = utf.read_toc(lambda at, n: _at(args.input, at, n), os.path.getsize(args.input))
        for f, _, size in a[2]:
            print(f"{size:>12} {f.id:>8} {f.path}")
        print(f"{len(a[2])} files")
    elif args.action == "extract":
        a = utf.read_cpk(_read(args.input))
        places = [inside(args.out, f.path) for f in a.files]
        for f, to in zip(a.files, places):
            _write(to, f.data)
        for name, packet in a.packets.items():
            _write(os.path.join(args.out, f"_{name.lower()}.bin"), packet)
        _write(os.path.join(args.out, "manifest.json"), exchange.dumps(exchange.cpk_to_json(a)).encode())
    else:
        doc = json.loads(_read(os.path.join(args.input, "manifest.json")))
        _write(args.out, utf.write_cpk(exchange.cpk_from_json(doc, lambda p: _read(inside(args.input, p)))))


def _at(path: str, at: int, n: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(n)


def _spc(args) -> None:
    if args.action == "pack":
        doc = json.loads(_read(os.path.join(args.input, "manifest.json")))
        exchange.check_tag(doc, "spc")
        _write(args.out, archive.write_spc(exchange.spc_from_json(doc, [_read(inside(args.input, e["name"])) for e in doc["entries"]])))
        return
    a = archive.read_spc(_read(args.input))
    if args.action == "list":
        for m in a.members:
            print(f"{len(m.data):>12} {m.flag} {m.name.decode(errors='replace')}")
        return
    manifest = exchange.spc_to_json(a)
    places = [inside(args.out, e["name"]) for e in manifest["entries"]]
    for m, to in zip(a.members, places):
        _write(to, m.data)
    _write(os.path.join(args.out, "manifest.json"), exchange.dumps(manifest).encode())


def _translate(args) -> int:
    from pyspark.sql import SparkSession

    from .plans import apply as plan
    from .sources.tables import register

    patch = plan.load(args.patch)
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
    spark = SparkSession.builder.master(f"local[{args.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    register(spark)
    files = plan.archives(spark, args.cpk)
    if args.action == "validate":
        for cpk, counts in sorted(plan.summary(patch).items()):
            print(cpk, counts)
        report, clean = plan.validate(spark, patch, files)
        print(f"{report['applied'] + report['skipped']} entries, {len(report['drift'])} drifted, {len(report['missing'])} missing")
        for r in (report["drift"] + report["missing"])[:10]:
            print(json.dumps(r, ensure_ascii=False))
        return 0 if clean else 1
    report = plan.write(plan.apply(spark, patch, files, args.on_drift), args.cpk, args.out, args.mode)
    if args.report:
        _write(args.report, exchange.dumps(report).encode())
    print(f"{report['applied']} applied, {report['already_translated']} of them already, {report['skipped']} skipped, {len(report['drift'])} drifted, {len(report['missing'])} missing")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top = parser.add_subparsers(dest="format", required=True)
    for kind in ("cpk", "spc"):
        p = top.add_parser(kind)
        p.add_argument("action", choices=["list", "extract", "pack"])
        p.add_argument("input")
        p.add_argument("out", nargs="?")
    for kind in FORMS:
        p = top.add_parser(kind)
        p.add_argument("action", choices=["dump", "build"] + ["dialogue"] * (kind == "wrd"))
        p.add_argument("input")
        p.add_argument("out", nargs="?")
    p = top.add_parser("srd")
    p.add_argument("action", choices=["inspect"])
    p.add_argument("input")
    p = top.add_parser("roundtrip")
    p.add_argument("inputs", nargs="+")
    p = top.add_parser("translate")
    p.add_argument("action", choices=["apply", "validate"])
    p.add_argument("--patch", nargs="+", required=True)
    p.add_argument("--cpk", nargs="+", required=True)
    p.add_argument("--out")
    p.add_argument("--mode", choices=["repack", "extract"], default="repack")
    p.add_argument("--on-drift", choices=["warn", "skip", "error"], default="warn")
    p.add_argument("--report")
    p.add_argument("--threads", type=int)
    args = parser.parse_args(argv)
    if getattr(args, "action", "") in ("extract", "pack", "dump", "build", "apply") and not args.out:
        parser.error(f"{args.action} needs a place for its output")
    try:
        if args.format == "cpk":
            _cpk(args)
        elif args.format == "spc":
            _spc(args)
        elif args.format == "srd":
            for r in font.flatten(font.read_srd(_read(args.input))):
                what = r["txr"] or ({k: r["rsi"][k] for k in ("count", "size")} | {"data": len(r["rsi"]["data"]), "strings": [s.decode(errors="replace") for s in r["rsi"]["strings"]]} if r["rsi"] else len(r["data"]))
                print("  " * r["depth"] + r["magic"], what)
        elif args.format == "roundtrip":
            results = [(p, *round_trip(p)) for p in args.inputs]
            for p, equal, at in results:
                print(p, "equal" if equal else f"differs at {at:#x}")
            return int(not all(equal for _, equal, _ in results))
        elif args.format == "translate":
            return _translate(args)
        elif args.action == "dialogue":
            s = text.read_wrd(_read(args.input))
            for who, id in text.dialogue(s.commands):
                print(f"{s.params[who] if who is not None and who < len(s.params) else '<unknown>'}\t{id}")
        else:
            read, write, to_json, from_json = FORMS[args.format]
            _write(args.out, exchange.dumps(to_json(read(_read(args.input)))).encode() if args.action == "dump" else write(from_json(json.loads(_read(args.input)))))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
