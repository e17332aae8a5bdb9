"""Log output of the driver."""

from __future__ import annotations

import logging
from pathlib import Path

NAME = "ratioscope"
_FORMAT = "%(asctime)s %(levelname)-7s %(name)s: %(message)s"


def setup_logging(level: str | int = "INFO", logfile: str | Path | None = None) -> logging.Logger:
    """The library's logger with one console handler and, if asked for, one file; calling again replaces them."""
    log = logging.getLogger(NAME)
    log.setLevel(level)
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    made: list[logging.Handler] = [logging.StreamHandler()]
    if logfile is not None:
        Path(logfile).parent.mkdir(parents=True, exist_ok=True)
        made.append(logging.FileHandler(logfile, encoding="utf-8"))
    for h in made:
        h.setFormatter(logging.Formatter(_FORMAT))
        log.addHandler(h)
    return log
