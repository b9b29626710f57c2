"""A gate against leaks: no given secret may appear in captured logs, exceptions or plans."""

from __future__ import annotations

import contextlib
import io
import logging
import traceback
from collections.abc import Iterable, Iterator


class Leaks(AssertionError):
    pass


def assert_no_leaks(text: str, secrets: Iterable[str], where: str = "output") -> None:
    found = [i for i, s in enumerate(secrets) if s and s in text]
    if found:
        raise Leaks(f"{len(found)} of the secrets (numbers {found[:5]}) appear in the {where}")


@contextlib.contextmanager
def leak_gate(secrets: Iterable[str]) -> Iterator[io.StringIO]:
    """Captures the root logger and an exception's whole text while the block runs, then looks for the secrets."""
    secrets, buf = list(secrets), io.StringIO()
    handler = logging.StreamHandler(buf)
    root = logging.getLogger()
    level = root.level
    root.addHandler(handler)
    root.setLevel(logging.DEBUG)
    try:
        yield buf
    except Leaks:
        raise
    except Exception:
        buf.write(traceback.format_exc())
        assert_no_leaks(buf.getvalue(), secrets, "exception or log")
        raise
    finally:
        root.removeHandler(handler)
        root.setLevel(level)
    assert_no_leaks(buf.getvalue(), secrets, "log")


def plan_text(df) -> str:
    """All of explain(extended) as text."""
    return df._jdf.queryExecution().toString()
