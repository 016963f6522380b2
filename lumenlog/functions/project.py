"""Project naming (F2) and display project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_name(project_dir: Column) -> Column:
    """'-Users-me-a-b' -> '~/a/b'; without a 'users' part -> '/' + parts joined by '/'."""
    name = F.regexp_replace(project_dir, "^-+", "")
    parts = F.split(name, "-", -1)
    idx = F.array_position(F.transform(parts, lambda p: F.lower(p)), F.lit("users"))
    rest_len = F.size(parts) - (idx + 1)
    rest = F.when(rest_len > 0, F.slice(parts, (idx + 2).cast("int"), rest_len.cast("int"))) \
        .otherwise(F.array().cast("array<string>"))
    return F.when(idx > 0, F.concat(F.lit("~/"), F.array_join(rest, "/"))) \
        .otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def display_project(cwd: Column, project_name_col: Column, home: str | None = None) -> Column:
    """Cwd (home replaced by '~' when it starts with home), else the project name.

    With ``home=None`` the cwd is used as is (the digest/compile/export form).
    """
    has_cwd = cwd.isNotNull() & (cwd != "")
    shown = cwd
    if home:
        shown = F.when(F.startswith(cwd, F.lit(home)), F.replace(cwd, F.lit(home), F.lit("~"))).otherwise(cwd)
    return F.when(has_cwd, shown).otherwise(project_name_col)


def project_name_sql(d: str) -> str:
    """F2 as a SQL expression over the SQL expression ``d`` (one JVM call to build)."""
    parts = f"split(regexp_replace({d}, '^-+', ''), '-', -1)"
    idx = f"array_position(transform({parts}, p -> lower(p)), 'users')"
    rest = f"size({parts}) - ({idx} + 1)"
    return (f"CASE WHEN {idx} > 0 THEN concat('~/', CASE WHEN {rest} > 0 THEN "
            f"array_join(slice({parts}, CAST({idx} + 2 AS INT), CAST({rest} AS INT)), '/') ELSE '' END) "
            f"ELSE concat('/', array_join({parts}, '/')) END")
