"""Record types of the code graph. Keys are natural: no surrogate ids."""

SCANNED_FILE = "path string, language string, size long, hash string"
SYMBOL = "path string, name string, kind string, signature string, qualified_name string, container_name string, parameters array<string>, return_type string, visibility string, language_kind string, start_line int, end_line int"
ROUTE = "framework string, method string, path string, name string, file_path string, symbol_name string"
EXTRACTED = f"symbols array<struct<{SYMBOL.replace(' string', ':string').replace(' array<string>', ':array<string>').replace(' int', ':int')}>>, imports array<string>, routes array<struct<{ROUTE.replace(' string', ':string')}>>"
EDGE = "from_type string, from_key string, to_type string, to_key string, kind string, weight double, confidence double"
SYMBOL_EDGE = "from_symbol string, to_symbol string, from_path string, to_path string, kind string, confidence double, evidence array<string>"
GUARD_FINDING = "file string, line int, column int, rule string, message string, confidence double"
DOCUMENT_TARGET = "path string, kind string, target_path string, confidence double, raw_value string, evidence_tier string"
DOCUMENT_STEP = "path string, phase string, ordinal int, title string, command string, target_path string, category string, raw_text string, confidence double"
MEMORY = "topic string, summary string, files array<string>, commands array<string>, tags array<string>, memory_type string, confidence double"
SCHEMA_VERSION = 1
