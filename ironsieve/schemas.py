"""Declared schemas: nothing is inferred."""

FINDING = (
    "id string, engine string, severity string, type string, file string, line int, description string, "
    "fix_suggestion string, auto_fixable boolean, context string"
)
SEMGREP = (
    "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,`end`:struct<line:int,col:int>,"
    "extra:struct<message:string,severity:string,fix:string>>>, errors array<string>"
)
GITLEAKS = (
    "Description string, File string, StartLine int, EndLine int, StartColumn int, EndColumn int, `Match` string, "
    "Secret string, RuleID string, Entropy double, Fingerprint string"
)
TRIVY = (
    "SchemaVersion int, Results array<struct<Target:string,Class:string,Type:string,Vulnerabilities:array<struct<"
    "VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string>>>>"
)
PACKAGE = (
    "name string, version string, dependencies map<string,string>, devDependencies map<string,string>, "
    "optionalDependencies map<string,string>, scripts map<string,string>"
)
LOCKFILE = "lockfileVersion int, packages map<string,struct<version:string,deprecated:string>>, dependencies map<string,struct<version:string>>"
MCP_CONFIG = "mcpServers map<string,struct<command:string,args:array<string>,env:map<string,string>>>"
EVENT = (
    "seq long, type string, timestamp string, project_id string, environment string, release string, session_id string, "
    "error struct<name:string,message:string,stack:string,handled:boolean>, "
    "context struct<url:string,method:string,status_code:int,user_agent:string>, "
    "metrics struct<page_load_ms:double,first_contentful_paint_ms:double,largest_contentful_paint_ms:double,"
    "cumulative_layout_shift:double,interaction_to_next_paint_ms:double,time_to_first_byte_ms:double>, url string, "
    "request struct<method:string,path:string,status_code:int,duration_ms:double>"
)
ERROR_GROUP = (
    "id string, project_id string, severity string, title string, file string, line int, root_cause string, "
    "suggested_fix string, users_affected long, occurrences long, first_seen string, last_seen string, status string, stack_trace string"
)
PARSED_FILE = (
    "file_seq long, file_path string, language string, "
    "functions array<struct<name:string,start_line:int,end_line:int,params:array<string>,is_async:boolean,is_exported:boolean,class_name:string>>, "
    "classes array<struct<name:string,start_line:int,end_line:int,methods:array<string>,is_exported:boolean>>, "
    "imports array<struct<source:string,specifiers:array<string>,line:int>>, "
    "exports array<struct<name:string,line:int,type:string>>, "
    "call_sites array<struct<caller_name:string,callee_name:string,line:int,receiver:string>>"
)
