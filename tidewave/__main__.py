"""Command line: ``python -m tidewave manifest build|verify FOLDER FILE``, ``python -m tidewave listen PORT``.

``listen`` prints one JSON line for each pose of ``--predictor module:function`` (windows (b, n) to poses (b, 63)), or
for each window without one.
"""

from __future__ import annotations

import argparse
import importlib
import socket
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidewave.errors import ModelUnavailableError


def port(text: str) -> int:
    n = int(text)
    if not 1 <= n <= 65535:
        raise argparse.ArgumentTypeError("a port lies between 1 and 65535")
    return n


def load_predictor(name: str | None, bundle: Path | None):
    """The function ``module:function``; with a bundle, on values standardised as the bundle says."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    try:
        backend = getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise ModelUnavailableError(f"{name}: {e}") from e
    if bundle is None:
        return backend
    from tidewave.model import Descriptor
    from tidewave.plans import checkpoint

    d = Descriptor()
    kept = checkpoint.read_bundle(str(bundle), d)
    predict = checkpoint.predictor(backend, kept["features"], kept["pose"])
    return lambda x: predict(x.reshape(len(x), 2, d.window_frames, d.crop_bins).swapaxes(2, 3))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewave")
    kinds = parser.add_subparsers(dest="what", required=True)
    m = kinds.add_parser("manifest")
    m.add_argument("action", choices=["build", "verify"])
    m.add_argument("folder")
    m.add_argument("file")
    live = kinds.add_parser("listen")
    live.add_argument("port", type=port)
    live.add_argument("--predictor")
    live.add_argument("--model-id", default="none")
    live.add_argument("--bundle", type=lambda p: Path(p).resolve())
    args = parser.parse_args(argv)
    if args.what == "manifest":
        from tidewave.operators import integrity

        spark = SparkSession.builder.getOrCreate()
        folder = str(Path(args.folder).resolve())
        files = integrity.tree(spark, folder)
        if args.action == "build":
            integrity.write_manifest(integrity.manifest(files), args.file, folder)
            return 0
        text = integrity.describe(integrity.verify(integrity.read_manifest(spark, args.file), files))
        print(text or "ok")
        return int(bool(text))
    from tidewave.streaming import live as lv
    from tidewave.streaming import wire

    packet = lv.Pipeline(load_predictor(args.predictor, args.bundle), args.model_id, emit=wire.LineSink(sys.stdout).emit).packet
    with socket.create_server(("0.0.0.0", args.port)) as server:
        conn, _ = server.accept()
        with conn:
            wire.consume(conn, packet)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
