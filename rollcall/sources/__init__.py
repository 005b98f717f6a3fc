from rollcall.sources.tables import (  # noqa: F401
    PERIOD_SCHEMAS,
    load_result,
    read_csv,
    read_periods,
    read_sheets,
    save_result,
    stack_periods,
)
