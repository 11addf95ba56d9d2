"""The registered queries: importing this package fills the registry."""

import importlib

for _name in ("memory_queries", "search_queries", "index_queries", "state_queries", "native_queries", "stream_queries", "document_queries", "store_queries"):
    importlib.import_module(f"{__name__}.{_name}")
