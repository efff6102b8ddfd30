from ladder.sources.relations import conform, own_relations
from ladder.sources.sinks import to_records, write_all, write_dashboard
from ladder.sources.tables import load_views, read_table, table_path
from ladder.sources.views import (
    build_views,
    city_suppliers,
    edu_spend,
    exact_ntile,
    institution,
    panel,
    panel_periods,
    parent_child,
    register_views,
)

__all__ = [
    "build_views", "city_suppliers", "conform", "edu_spend", "exact_ntile", "institution", "load_views", "own_relations", "panel",
    "panel_periods", "parent_child", "read_table", "register_views", "table_path", "to_records", "write_all",
    "write_dashboard",
]
