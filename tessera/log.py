"""Logging: one line of JSON for each record, to a rotating file and to standard error."""

from __future__ import annotations

import json
import logging
import sys
from logging.handlers import RotatingFileHandler

#: What a record has by itself; everything else was given as ``extra``.
_OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def setup_logger(name: str, file: str | None = None, level: int = logging.INFO, max_bytes: int = 5 << 20, backups: int = 3) -> logging.Logger:
    """The logger of that name; handlers are added once, however often it is set up."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    logger.propagate = False
    if not any(isinstance(h, logging.StreamHandler) and not isinstance(h, logging.FileHandler) for h in logger.handlers):
        logger.addHandler(logging.StreamHandler(sys.stderr))
    if file and not any(isinstance(h, RotatingFileHandler) for h in logger.handlers):
        logger.addHandler(RotatingFileHandler(file, maxBytes=max_bytes, backupCount=backups, encoding="utf-8"))
    for handler in logger.handlers:
        handler.setFormatter(JsonLines())
    return logger
