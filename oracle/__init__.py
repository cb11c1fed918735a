"""DuckDB SQL that recomputes each registered query independently."""

from .reports import REPORTS
from .tables import TABLES

# Without SQL: export_json is text of checked parts.
ORACLES: dict[str, str] = TABLES | REPORTS
