from daymark.sources.io import (  # noqa: F401
    SourceContractError,
    check_sources,
    read_mart,
    read_source,
    reload_output,
    resolve_column,
    write_output,
)
