"""Schemas of the library's relations, as DDL; nothing is inferred."""

FILES = "rel_path string, name string, size bigint, extension string, importance_score double, content string"
CLAIMS = "ord int, from string, to string, dependency_type string, importance int, description string"
FILE_EDGES = "importer string, target string, kind string, test_only boolean, line int"
IMPORT_STATS = "importer string, total bigint, unresolved bigint"
NODES = "node_id string, kind string"
FINDINGS = "id string, class string, from string, to string, kind string, importance int, reason string, detail string, evidence array<struct<file:string,target:string,line:int>>"
SNAPSHOT_FILES, SNAPSHOT_DIRS, SNAPSHOT_EDGES = "path string, hash string", "dir string, sig string", "importer string, target string"
CALLS = "ts string, agent string, backend string, model string, prompt_chars bigint, secs double, status string, input_tokens bigint, output_tokens bigint"
INSIGHTS = "dir string, idx int, name string, file_path string, purpose string, importance_score double, summary string, interfaces array<struct<name:string,interface_type:string,signature:string>>"
DOSSIERS = "dir string, name string, purpose string, n_files bigint, subdirectories bigint, importance_score double, summary string, key_files array<string>"
DOMAINS = "name string, domain_type string, description string, importance double, complexity double, code_paths array<string>, sub_modules array<struct<name:string,description:string,code_paths:array<string>>>"
FLOWS = "name string, description string, steps array<struct<step:int,domain_module:string,sub_module:string,operation:string,code_entry_point:string>>"
SYSTEM_CONTEXT = "project_name string, project_type string, business_value string, boundary struct<scope:string,included_components:array<string>,excluded_components:array<string>>, confidence double"
TABLES = "name string, schema_name string, columns array<struct<name:string,data_type:string,nullable:boolean,is_primary_key:boolean>>"
