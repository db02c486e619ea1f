"""Schemas of the tables and nested facts; nothing in the library infers a schema."""

from __future__ import annotations

LOCATION = "struct<filePath:string,startLine:int,endLine:int>"
FUNCTION = f"struct<name:string,params:array<string>,returnType:string,isAsync:boolean,isExported:boolean,location:{LOCATION}>"
CLASS = f"struct<name:string,extends:string,implements:array<string>,methods:array<{FUNCTION}>,isAbstract:boolean,location:{LOCATION}>"
IMPORT = "struct<source:string,specifiers:array<string>,isDefault:boolean>"
EXPORT = "struct<name:string,isDefault:boolean>"
HINT = "struct<framework:string,hint:string>"

FACTS = f"language string, imports array<{IMPORT}>, exports array<{EXPORT}>, classes array<{CLASS}>, functions array<{FUNCTION}>, frameworkHints array<{HINT}>"
PARSED_FILE = f"id string, repositoryId string, path string, contentHash string, {FACTS}, metadata struct<parserVersion:string,parsedAt:timestamp,parseDurationMs:int>, error string"

NODES = "id string, type string, label string, repositoryId string, filePath string, metadataJson string"
EDGES = "id string, sourceId string, targetId string, type string, properties map<string,string>"
CHUNKS = "id string, repositoryId string, nodeId string, filePath string, nodeType string, name string, content string, startLine int, endLine int, embedding array<float>"
DELIVERIES = "repositoryId string, rawBody binary, deliveryId string, event string, signature string, receivedAt timestamp"
PUSH = "ref string, after string, repository struct<full_name:string,default_branch:string>, head_commit struct<id:string,message:string>"
WEBHOOK_EVENTS = "id string, repositoryId string, eventType string, deliveryId string, receivedAt timestamp, processedAt timestamp, status string, payloadHash string, errorMessage string"
MESSAGES = "id string, sessionId string, role string, content string, intent string, references array<struct<nodeId:string,file:string,name:string>>, durationMs int, rating int, createdAt timestamp"
ANALYSES = "id string, repositoryId string, prUrl string, changedFiles array<string>, impactedNodes array<struct<nodeId:string,file:string,name:string,hop:int,relationship:string>>, summary string, references array<struct<nodeId:string,file:string,name:string>>, durationMs int, createdAt timestamp"
JOBS = "repositoryId string, jobId string, triggeredBy string, webhookEventId string"
METRICS = "repositoryId string, jobId string, changedFiles int, newFiles int, deletedFiles int, unchangedFiles int, parseDurationMs int, graphBuildDurationMs int, embedDurationMs int, totalDurationMs int, chunkCount int, nodeCount int, edgeCount int, recordedAt timestamp"

# The closed sets of names.
NODE_TYPES = ["repository", "service", "module", "file", "class", "interface", "function", "controller", "api", "database", "external_dependency"]
EDGE_TYPES = ["CONTAINS", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "USES", "DEPENDS_ON", "EXPOSES_API"]
INTENTS = ["explain-arch", "trace-flow", "locate-logic", "explain-deps", "find-ownership"]
REPOSITORY_STATUS = ["pending", "cloning", "re_ingesting", "parsing", "building_graph", "indexing", "ready", "error"]
