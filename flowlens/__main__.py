"""Command line: ``python -m flowlens <command> ...`` (or ``spark-submit``
with this file). Each command is one pipeline of :mod:`flowlens.plans.pipelines`.

    train   --data flows.csv --output out/model/anomaly_model [--contamination 0.05]
    detect  --data flows.csv --model out/model/anomaly_model --output out/run [--detailed]
    pcap    --pcap captures/ --model out/model/pcap_model --output out/pcap [--detailed]
    convert --input packet_list.csv --output converted/
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):  # run as a file (spark-submit flowlens/__main__.py)
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlens.schema import DEFAULT_CONTAMINATION  # noqa: E402


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowlens", description="Flow anomaly analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="train and save a model")
    t.add_argument("--data", required=True)
    t.add_argument("--output", required=True, help="model directory")
    t.add_argument("--contamination", type=float, default=DEFAULT_CONTAMINATION)
    t.add_argument("--format", default=None, help="parquet, csv or json (default: by extension)")
    d = sub.add_parser("detect", help="score flows and run the detectors")
    d.add_argument("--data", required=True)
    d.add_argument("--model", required=True)
    d.add_argument("--output", required=True, help="output directory")
    d.add_argument("--detailed", action="store_true", help="lateral, exfiltration, ICS, summary")
    d.add_argument("--format", default=None)
    d.add_argument("--assets", default=None, help="optional table of known asset addresses (column ip)")
    c = sub.add_parser("pcap", help="analyse a directory of capture files")
    c.add_argument("--pcap", required=True)
    c.add_argument("--model", required=True, help="used if present, else trained and saved")
    c.add_argument("--output", required=True)
    c.add_argument("--detailed", action="store_true")
    v = sub.add_parser("convert", help="packet-list CSV export to the flow schema")
    v.add_argument("--input", required=True)
    v.add_argument("--output", required=True)
    return p


def main(argv=None) -> dict:
    args = build_parser().parse_args(argv)
    from flowlens.plans import pipelines
    from flowlens.session import get_spark
    spark = get_spark()
    if args.command == "train":
        res = pipelines.train_pipeline(spark, args.data, args.output, args.contamination, args.format)
    elif args.command == "detect":
        assets = None
        if args.assets:
            from flowlens.sources.flows import read_flows
            assets = read_flows(spark, args.assets)
        res = pipelines.detect_pipeline(spark, args.data, args.model, args.output, args.detailed,
                                        args.format, assets)
    elif args.command == "pcap":
        res = pipelines.packet_pipeline(spark, args.pcap, args.model, args.output, args.detailed)
    else:
        res = pipelines.convert_pipeline(spark, args.input, args.output)
    print(json.dumps(res, default=str))
    return res


if __name__ == "__main__":
    main(sys.argv[1:])
