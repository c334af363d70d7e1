"""What the jobs' command lines share: a small JSON file of settings, arguments that go before it, and logging."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path


def settings(about: str, default: str, paths: list[str], argv: list[str] | None = None) -> dict:
    """The settings of the file named by --config (by default the one beside the job), with the paths given as arguments in place of
    its own. The file is a local one, read by the driver; what it names may be anywhere that Spark reads."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=str(Path(__file__).resolve().parent / default))
    for name in paths:
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    chosen = json.loads(Path(given.pop("config")).read_text())
    chosen |= {k: v for k, v in given.items() if v is not None}
    if missing := [x for x in paths if not chosen.get(x)]:
        parser.error(f"no path for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return chosen
