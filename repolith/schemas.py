"""Explicit schemas of the records that language front ends produce; nothing is inferred."""

PARAM = "struct<name:string,type:string,modifier:string>"
METHODS = (
    f"name string, signature string, beginLine int, endLine int, filename string, modifier string, params array<{PARAM}>, returnType string, callees array<string>, "
    "code string, isStatic boolean, isExported boolean, access string, outermethod string, modifiers string, _corrupt_record string"
)
STRUCTS = (
    "name string, fullname string, signature string, filename string, beginLine int, code string, modifier string, isExported boolean, inheritsFromTypeFullName array<string>, "
    "methods array<string>, attributes array<struct<name:string,type:string,modifier:string,access:string>>, _corrupt_record string"
)
TAGS = "name string, filename string, pattern string, kind string"
LOCATION = "struct<file:string,start_line:int,end_line:int>"
DOCUMENTATION = (
    "project struct<name:string,version:string,description:string,license:string,repository:string>, "
    "modules array<struct<path:string,name:string,doc_comment:string,public_items:array<string>,submodules:array<string>,examples:array<string>>>, "
    f"functions array<struct<signature:string,name:string,doc_comment:string,return_doc:string,examples:array<string>,location:{LOCATION}>>, "
    f"types array<struct<name:string,fullname:string,type_kind:string,doc_comment:string,methods:array<string>,location:{LOCATION}>>, "
    f"macros array<struct<name:string,macro_type:string,doc_comment:string,location:{LOCATION}>>, "
    f"constants array<struct<name:string,const_type:string,value:string,doc_comment:string,location:{LOCATION}>>"
)
MAPPED = "array<struct<standard_id:string,standard_name:string,raw_feature_description:string,confidence:double,reasoning:string>>"
PROFILE = f"software_name string, version string, description string, mapped_features {MAPPED}, unmapped_features array<string>, coverage_score double, status string, error string"
FEATURES = "model string, version string, id string, parent_id string, name string, description string, ord int"
BATCH = "domain string, repos array<struct<path:string,repo:string,language:string,lang:string>>"
DECISION = (
    "action string, raw_feature string, reasoning string, new_feature_name string, new_feature_description string, parent_feature_id string, target_feature_id string, updated_description string"
)

#: Languages with their fence names and command-line names.
LANGUAGES = (("C", "c", "c"), ("C++", "cpp", "cpp"), ("JavaScript", "javascript", "js"), ("Rust", "rust", "rust"), ("ArkTS", "typescript", "arkts"), ("TypeScript", "typescript", "ts"))
