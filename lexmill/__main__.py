"""Command line: python -m lexmill CORPUS."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from lexmill import __version__
from lexmill.config import Settings


def _within(low: int, high: int | None = None):
    def number(text: str) -> int:
        n = int(text)
        if n < low or (high is not None and n > high):
            raise argparse.ArgumentTypeError(f"{n} is not {low} or more" + (f" and {high} or less" if high is not None else ""))
        return n

    return number


def _folder(text: str) -> str:
    if not os.path.isdir(text) or not os.access(text, os.W_OK):
        raise argparse.ArgumentTypeError(f"{text} is not a folder that can be written to")
    return text


def parser() -> argparse.ArgumentParser:
    d = Settings()
    p = argparse.ArgumentParser("lexmill", description="Discover words in raw text files.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("input_path", help="a text file, or a folder of text files")
    p.add_argument("-o", "--output", help="the file to write; by default named after the input and the date")
    p.add_argument("-l", "--max-len", type=_within(2, 32), default=d.max_len, help="characters of the longest word")
    p.add_argument("-m", "--mem", type=_within(1), default=4096, help="MB of memory of a local session")
    p.add_argument("-w", "--workers", type=_within(1), default=max(1, (os.cpu_count() or 2) // 2), help="threads of a local session")
    p.add_argument("--min-freq", type=_within(1), default=d.min_freq, help="occurrences of the rarest word")
    p.add_argument("--pos-prop", help="table of positions: character, P(start), P(middle), P(end)")
    p.add_argument("--tags", help="table of parts of speech: word, tag")
    p.add_argument("--pmi-threshold", type=float, default=d.pmi)
    p.add_argument("--entropy-threshold", type=float, default=d.entropy)
    p.add_argument("--pos-threshold", type=float, default=d.position)
    p.add_argument("--temp-dir", type=_folder, help="where the folder of intermediate data is made")
    p.add_argument("--work-dir", help="folder of stages, to resume an interrupted run")
    p.add_argument("--force", action="store_true", help="start over, whatever is in the work folder")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if "://" not in a.input_path and not os.path.exists(a.input_path):
        p.error(f"no such file or folder: {a.input_path}")
    logging.basicConfig(format="%(message)s", level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    from lexmill.plans.job import run
    from lexmill.sources.sinks import single_session

    settings = Settings(max_len=a.max_len, min_freq=a.min_freq, pmi=a.pmi_threshold, entropy=a.entropy_threshold, position=a.pos_threshold)
    spark = single_session(memory_mb=a.mem, workers=a.workers)
    path = run(a.input_path, a.output, settings, a.pos_prop, a.tags, a.temp_dir, a.work_dir, a.force, spark)
    print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
