"""Column layout, as DDL, of every table the engine reads or writes."""

NOTES = (
    "pk bigint, id string, title string, folder_pk bigint, modified timestamp, marked boolean, "
    "pinned boolean, locked boolean, shared boolean, zone_owner string, body string"
)
FOLDERS = (
    "pk bigint, id string, name string, parent_pk bigint, folder_type int, account_pk bigint, "
    "marked boolean, has_server_record boolean, needs_fetch boolean, shared boolean"
)
CHANGES = "entity int, entity_pk bigint, change_type int"

NODES = (
    "id string, z_pk bigint, title string, folder string, modified_at bigint, locked boolean, "
    "pinned boolean, content_hash string, body string"
)
CHUNKS = (
    "id string, node_id string, chunk_index int, heading string, heading_level int, content string, "
    "content_hash string, start_line int, end_line int, embedding array<float>"
)
POSTINGS = "term string, node_id string, length int, title_at array<int>, body_at array<int>"
FAILED = "chunk_id string, node_id string, reason string, error_message string, failed_at bigint"
CAPACITY = "provider string, advertised int, discovered int, discovered_at bigint, fetched_at bigint"
METADATA = "key string, value string, updated_at bigint"

# Element of the array the chunker returns.
CHUNK_ELEMENT = (
    "struct<chunk_index:int,heading:string,heading_level:int,content:string,"
    "content_hash:string,start_line:int,end_line:int>"
)

# Entity numbers and the delete code of the change log.
ENTITY_ATTACHMENT = 5
ENTITY_NOTE = 12
ENTITY_ACCOUNT = 14
ENTITY_FOLDER = 15
CHANGE_DELETE = 2
FOLDER_TYPE_TRASH = 1
