"""What tests of the reports share besides fixtures; a module of its own name, as every folder has a conftest."""

from __future__ import annotations

import contextlib


@contextlib.contextmanager
def settings(spark, **pairs):
    names = {name.replace("__", "."): value for name, value in pairs.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def rows_of(frame, *columns):
    """Rows as tuples, of the given columns or all, sorted without regard to NULLs."""
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(row) for row in picked.collect()), key=lambda row: [str(v) for v in row])
