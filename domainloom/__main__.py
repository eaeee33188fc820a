"""python -m domainloom {embed,build-index,annotate,evaluate,train} key=value ..."""

from __future__ import annotations

import sys

from . import runs
from .config import AnnotateConfig, EmbedConfig, IndexConfig, TrainRunConfig, override
from .session import get_session

COMMANDS = {
    "embed": (EmbedConfig, runs.run_embed), "build-index": (IndexConfig, runs.run_build_index),
    "annotate": (AnnotateConfig, runs.run_annotate), "evaluate": (AnnotateConfig, runs.run_evaluate), "train": (TrainRunConfig, runs.run_train),
}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    settings, run = COMMANDS[argv[0]]
    done = run(get_session(), override(settings(), argv[1:]))
    if isinstance(done, dict):
        for key, value in done.items():
            print(f"{key}\t{value}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
