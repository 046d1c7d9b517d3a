"""The built-in rules.

The tables below are fixed values: the identifiers, patterns, tags, severities, argument positions and weakness numbers that users' reports and
configurations name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tag groups.
TAGS = ("code", "command", "header", "html", "nosql", "path", "sql", "unknown", "url")
GROUPS = {
    "REQ": TAGS,
    "ENV": TAGS,
    "BRW": tuple(t for t in TAGS if t != "command"),
    "URL": ("html", "path", "unknown", "url"),
    "NUM": ("code", "command", "html", "nosql", "path", "sql", "url"),
}

#: Sources. id, pattern, tags.
SOURCES = """
express-query | member=req.query | REQ
express-body | member=req.body | REQ
express-params | member=req.params | REQ
express-headers | member=req.headers | REQ
express-cookies | member=req.cookies | REQ
express-param-call | member=req.param | REQ
express-get-header | member=req.get | REQ
express-header-call | member=req.header | REQ
express-url | member=req.url | URL
express-original-url | member=req.originalUrl | URL
express-path | member=req.path | URL
express-request-identifier | identifier=req | REQ
express-request-args | identifier=request | REQ
koa-query | member=ctx.query | REQ
koa-querystring | member=ctx.querystring | URL
koa-params | member=ctx.params | REQ
koa-headers | member=ctx.headers | REQ
koa-request-body | member=ctx.request.body | REQ
koa-request-query | member=ctx.request.query | REQ
koa-cookies-get | member=ctx.cookies.get | REQ
koa-url | member=ctx.url | URL
koa-original-url | member=ctx.originalUrl | URL
request-query | member=request.query | REQ
request-body | member=request.body | REQ
request-params | member=request.params | REQ
request-headers | member=request.headers | REQ
request-cookies | member=request.cookies | REQ
request-url | member=request.url | URL
request-raw-url | member=request.raw.url | URL
lambda-query-string | member=event.queryStringParameters | REQ
lambda-body | member=event.body | REQ
lambda-path-parameters | member=event.pathParameters | REQ
lambda-headers | member=event.headers | REQ
legacy-get-parameter | call=getParameter | REQ
location-search | member=location.search | BRW
location-hash | member=location.hash | BRW
location-href | member=location.href | BRW
location-pathname | member=location.pathname | BRW
window-location | member=window.location | BRW
document-location | member=document.location | BRW
window-name | member=window.name | BRW
document-url | member=document.URL | BRW
document-referrer | member=document.referrer | BRW
document-cookie | member=document.cookie | BRW
document-base-uri | member=document.baseURI | BRW
process-argv | member=process.argv | ENV
process-env | member=process.env | ENV
"""

#: Sanitisers. id, pattern, tags that they clear, validation.
SANITIZERS = """
sql-db-query | member=db.query | sql | static-sql
sql-connection-query | member=connection.query | sql | static-sql
sql-pool-query | member=pool.query | sql | static-sql
sql-client-query | member=client.query | sql | static-sql
sql-conn-query | member=conn.query | sql | static-sql
sql-db-execute | member=db.execute | sql | static-sql
sql-connection-execute | member=connection.execute | sql | static-sql
sql-pool-execute | member=pool.execute | sql | static-sql
sql-sequelize-query | member=sequelize.query | sql | static-sql
sql-knex-raw | member=knex.raw | sql | static-sql
sql-mysql-escape | member=mysql.escape | sql | none
html-escape-html | call=escapeHtml | html | none
html-escape | call=escape | html | none
html-he-encode | member=he.encode | html | none
html-he-escape | member=he.escape | html | none
html-dompurify-sanitize | member=DOMPurify.sanitize | html | none
html-sanitize-html | call=sanitizeHtml | html | none
html-xss | call=xss | html | none
html-encode-uri-component | call=encodeURIComponent | html | none
command-shell-quote | call=shellQuote | command | none
command-shell-escape | call=shellEscape | command | none
command-exec-file-constant | member=child_process.execFile | command | constant-argument
command-exec-file-sync-constant | member=child_process.execFileSync | command | constant-argument
path-basename | member=path.basename | path | none
path-sanitize-filename | call=sanitizeFilename | path | none
path-filenamify | call=filenamify | path | none
nosql-mongo-sanitize | member=mongoSanitize.sanitize | nosql | none
nosql-sanitize-filter | call=sanitizeFilter | nosql | none
url-sanitize-url | call=sanitizeUrl | url | none
coerce-parse-int | call=parseInt | NUM | none
coerce-number-parse-int | member=Number.parseInt | NUM | none
coerce-parse-float | call=parseFloat | NUM | none
coerce-number-parse-float | member=Number.parseFloat | NUM | none
coerce-number | call=Number | NUM | none
"""

#: Sinks. id, pattern, tags, severity, tainted arguments, weaknesses.
SINKS = """
sql-query | call=query | sql | error | 0 | CWE-89
sql-execute | call=execute | sql | error | 0 | CWE-89
sql-raw | call=raw | sql | error | 0 | CWE-89
sql-prepare | call=prepare | sql | error | 0 | CWE-89
sql-query-raw | call=queryRaw | sql | error | 0 | CWE-89
sql-execute-raw | call=executeRaw | sql | error | 0 | CWE-89
sql-query-raw-unsafe | call=$queryRawUnsafe | sql | error | 0 | CWE-89
sql-execute-raw-unsafe | call=$executeRawUnsafe | sql | error | 0 | CWE-89
sql-knex-raw | member=knex.raw call=raw | sql | error | 0 | CWE-89
sql-sequelize-query | member=sequelize.query call=query | sql | error | 0 | CWE-89
sql-db-exec | member=db.exec call=exec | sql | error | 0 | CWE-89
xss-inner-html | member=.innerHTML | html | error | 0 | CWE-79
xss-outer-html | member=.outerHTML | html | error | 0 | CWE-79
xss-insert-adjacent-html | call=insertAdjacentHTML | html | error | 0 | CWE-79
xss-dangerously-set-inner-html | member=.dangerouslySetInnerHTML | html | error | 0 | CWE-79
xss-document-write | member=document.write call=write | html | error | 0 | CWE-79
xss-document-writeln | member=document.writeln call=writeln | html | error | 0 | CWE-79
xss-jquery-html | call=html | html | warning | 0 | CWE-79
xss-res-send | member=res.send call=send | html | warning | 0 | CWE-79
xss-res-write | member=res.write call=write | html | warning | 0 | CWE-79
xss-res-end | member=res.end call=end | html | warning | 0 | CWE-79
xss-res-jsonp | member=res.jsonp call=jsonp | html | warning | 0 | CWE-79
xss-reply-send | member=reply.send call=send | html | warning | 0 | CWE-79
xss-ctx-body | member=ctx.body | html | warning | 0 | CWE-79
command-exec | call=exec | command | error | 0 | CWE-78
command-exec-sync | call=execSync | command | error | 0 | CWE-78
command-exec-file | call=execFile | command | error | 0 | CWE-78
command-exec-file-sync | call=execFileSync | command | error | 0 | CWE-78
command-spawn | call=spawn | command | error | 0 | CWE-78
command-spawn-sync | call=spawnSync | command | error | 0 | CWE-78
command-fork | call=fork | command | error | 0 | CWE-78
command-child-process-exec | member=child_process.exec call=exec | command | error | 0 | CWE-78
command-child-process-exec-sync | member=child_process.execSync call=execSync | command | error | 0 | CWE-78
command-child-process-fork | member=child_process.fork call=fork | command | error | 0 | CWE-78
command-shelljs-exec | member=shell.exec call=exec | command | error | 0 | CWE-78
path-fs-read-file | call=readFile | path | error | 0 | CWE-22
path-fs-read-file-sync | call=readFileSync | path | error | 0 | CWE-22
path-fs-create-read-stream | call=createReadStream | path | error | 0 | CWE-22
path-fs-write-file | call=writeFile | path | error | 0 | CWE-22
path-fs-write-file-sync | call=writeFileSync | path | error | 0 | CWE-22
path-fs-create-write-stream | call=createWriteStream | path | error | 0 | CWE-22
path-fs-append-file | call=appendFile | path | error | 0 | CWE-22
path-fs-append-file-sync | call=appendFileSync | path | error | 0 | CWE-22
path-fs-unlink | call=unlink | path | error | 0 | CWE-22
path-fs-unlink-sync | call=unlinkSync | path | error | 0 | CWE-22
path-fs-rm | call=rm | path | error | 0 | CWE-22
path-fs-rm-sync | call=rmSync | path | error | 0 | CWE-22
path-fs-mkdir | call=mkdir | path | error | 0 | CWE-22
path-fs-mkdir-sync | call=mkdirSync | path | error | 0 | CWE-22
path-fs-readdir | call=readdir | path | error | 0 | CWE-22
path-fs-readdir-sync | call=readdirSync | path | error | 0 | CWE-22
path-fs-opendir | call=opendir | path | error | 0 | CWE-22
path-fs-stat | call=stat | path | error | 0 | CWE-22
path-fs-stat-sync | call=statSync | path | error | 0 | CWE-22
path-fs-lstat | call=lstat | path | error | 0 | CWE-22
path-fs-open | call=open | path | error | 0 | CWE-22
path-fs-open-sync | call=openSync | path | error | 0 | CWE-22
path-fs-copy-file | call=copyFile | path | error | 0 | CWE-22
path-fs-copy-file-sync | call=copyFileSync | path | error | 0 | CWE-22
path-fs-rename | call=rename | path | error | 0 | CWE-22
path-fs-rename-sync | call=renameSync | path | error | 0 | CWE-22
path-fs-chmod | call=chmod | path | error | 0 | CWE-22
path-fs-chmod-sync | call=chmodSync | path | error | 0 | CWE-22
path-fs-symlink | call=symlink | path | error | 0 | CWE-22
path-fs-readlink | call=readlink | path | error | 0 | CWE-22
path-fs-realpath | call=realpath | path | error | 0 | CWE-22
path-fs-truncate | call=truncate | path | error | 0 | CWE-22
path-res-send-file | member=res.sendFile call=sendFile | path | error | 0 | CWE-22
path-reply-send-file | member=reply.sendFile call=sendFile | path | error | 0 | CWE-22
path-res-download | member=res.download call=download | path | error | 0 | CWE-22
path-send-file | call=sendFile | path | error | 0 | CWE-22
path-download | call=download | path | error | 0 | CWE-22
path-res-render-view | member=res.render call=render | path | warning | 0 | CWE-22
path-require | call=require | path | error | 0 | CWE-22
code-eval | call=eval | code | error | 0 | CWE-94
code-function-constructor | call=Function | code | error | 0 | CWE-94
code-settimeout | call=setTimeout | code | warning | 0 | CWE-94
code-setinterval | call=setInterval | code | warning | 0 | CWE-94
code-vm-run-in-new-context | member=vm.runInNewContext call=runInNewContext | code | error | 0 | CWE-94
code-vm-run-in-this-context | member=vm.runInThisContext call=runInThisContext | code | error | 0 | CWE-94
code-vm-run-in-context | member=vm.runInContext call=runInContext | code | error | 0 | CWE-94
code-vm-compile-function | member=vm.compileFunction call=compileFunction | code | error | 0 | CWE-94
code-vm-script | member=vm.Script | code | error | 0 | CWE-94
code-node-serialize | call=unserialize | code | error | 0 | CWE-502
code-lodash-template | member=_.template call=template | code | error | 0 | CWE-94
code-handlebars-compile | member=handlebars.compile call=compile | code,html | error | 0 | CWE-94, CWE-1336
code-ejs-render | member=ejs.render call=render | code,html | error | 0 | CWE-94, CWE-1336
code-pug-render | member=pug.render call=render | code,html | error | 0 | CWE-94, CWE-1336
code-nunjucks-render-string | member=nunjucks.renderString call=renderString | code,html | error | 0 | CWE-94, CWE-1336
nosql-find | call=find | nosql | warning | 0 | CWE-943
nosql-find-one | call=findOne | nosql | warning | 0 | CWE-943
nosql-find-by-id | call=findById | nosql | warning | 0 | CWE-943
nosql-find-one-and-update | call=findOneAndUpdate | nosql | warning | 0 | CWE-943
nosql-find-one-and-delete | call=findOneAndDelete | nosql | warning | 0 | CWE-943
nosql-find-one-and-replace | call=findOneAndReplace | nosql | warning | 0 | CWE-943
nosql-update-one | call=updateOne | nosql | warning | 0 | CWE-943
nosql-update-many | call=updateMany | nosql | warning | 0 | CWE-943
nosql-delete-one | call=deleteOne | nosql | warning | 0 | CWE-943
nosql-delete-many | call=deleteMany | nosql | warning | 0 | CWE-943
nosql-replace-one | call=replaceOne | nosql | warning | 0 | CWE-943
nosql-count-documents | call=countDocuments | nosql | warning | 0 | CWE-943
nosql-distinct | call=distinct | nosql | warning | 0 | CWE-943
nosql-aggregate | call=aggregate | nosql | warning | 0 | CWE-943
nosql-bulk-write | call=bulkWrite | nosql | warning | 0 | CWE-943
nosql-map-reduce | call=mapReduce | nosql | warning | 0 | CWE-943
nosql-where-operator | member=.$where | code,nosql | error | all | CWE-943
redirect-res | member=res.redirect call=redirect | url | warning | 0 | CWE-601
redirect-reply | member=reply.redirect call=redirect | url | warning | 0 | CWE-601
redirect-ctx | member=ctx.redirect call=redirect | url | warning | 0 | CWE-601
redirect-bare | call=redirect | url | warning | 0 | CWE-601
redirect-res-location | member=res.location call=location | url | warning | 0 | CWE-601
redirect-location-assign | member=location.assign call=assign | url | warning | 0 | CWE-601
redirect-location-replace | member=location.replace call=replace | url | warning | 0 | CWE-601
redirect-location-href | member=location.href | url | warning | 0 | CWE-601
redirect-window-location | member=window.location | url | warning | 0 | CWE-601
redirect-navigate | call=navigate | url | warning | 0 | CWE-601
redirect-router-push | member=router.push call=push | url | warning | 0 | CWE-601
ssrf-fetch | call=fetch | url | error | 0 | CWE-918
ssrf-axios-get | member=axios.get call=get | url | error | 0 | CWE-918
ssrf-axios-post | member=axios.post call=post | url | error | 0 | CWE-918
ssrf-axios-put | member=axios.put call=put | url | error | 0 | CWE-918
ssrf-axios-patch | member=axios.patch call=patch | url | error | 0 | CWE-918
ssrf-axios-delete | member=axios.delete call=delete | url | error | 0 | CWE-918
ssrf-axios-head | member=axios.head call=head | url | error | 0 | CWE-918
ssrf-axios-options | member=axios.options call=options | url | error | 0 | CWE-918
ssrf-axios-request | member=axios.request call=request | url | error | 0 | CWE-918
ssrf-axios-call | call=axios | url | error | 0 | CWE-918
ssrf-http-request | member=http.request call=request | url | error | 0 | CWE-918
ssrf-http-get | member=http.get call=get | url | error | 0 | CWE-918
ssrf-https-request | member=https.request call=request | url | error | 0 | CWE-918
ssrf-https-get | member=https.get call=get | url | error | 0 | CWE-918
ssrf-undici-request | member=undici.request call=request | url | error | 0 | CWE-918
ssrf-got | call=got | url | error | 0 | CWE-918
ssrf-request | call=request | url | error | 0 | CWE-918
ssrf-superagent | member=superagent.get call=get | url | error | 0 | CWE-918
ssrf-websocket | call=WebSocket | url | error | 0 | CWE-918
ssrf-net-connect | member=net.connect call=connect | url | error | 1 | CWE-918
ssrf-tls-connect | member=tls.connect call=connect | url | error | 1 | CWE-918
header-res-set-header | member=res.setHeader call=setHeader | header,url | warning | 0 | CWE-113
header-res-set | member=res.set call=set | header,url | warning | 0 | CWE-113
header-res-header | member=res.header call=header | header,url | warning | 0 | CWE-113
header-res-cookie | member=res.cookie call=cookie | header,url | warning | 0 | CWE-113
header-reply-header | member=reply.header call=header | header,url | warning | 0 | CWE-113
header-ctx-set | member=ctx.set call=set | header,url | warning | 0 | CWE-113
header-ctx-cookies-set | member=ctx.cookies.set call=set | header,url | warning | 0 | CWE-113
note-dom-href | member=.href | url | note | all | CWE-79
note-dom-src | member=.src | url | note | 0 | CWE-79
"""

#: Propagators. They are part of the catalogue; propagation runs through every call, so the kernel does not read them.
PROPAGATORS = """
member=JSON.parse
member=JSON.stringify
member=Object.assign
member=Object.fromEntries
member=Array.from
member=Array.of
call=String
call=Boolean
member=Buffer.from
member=Buffer.concat
call=decodeURI
call=decodeURIComponent
call=encodeURI
member=URLSearchParams
member=querystring.parse
member=querystring.stringify
member=qs.parse
member=qs.stringify
member=url.parse
member=path.join
member=path.resolve
member=path.normalize
member=path.dirname
member=util.format
member=util.inspect
member=_.get
member=_.merge
member=_.assign
member=_.clone
member=_.cloneDeep
member=_.pick
member=_.omit
member=_.defaults
member=_.values
member=res.locals
member=app.locals
member=ctx.state
member=request.headers
call=concat
call=join
call=slice
call=substring
call=substr
call=trim
call=trimStart
call=trimEnd
call=toLowerCase
call=toUpperCase
call=replace
call=replaceAll
call=split
call=padStart
call=padEnd
call=repeat
call=normalize
call=charAt
call=toString
call=map
call=filter
call=flat
call=flatMap
call=reduce
call=sort
call=reverse
"""

#: What a finding of a weakness says, and what helps.
ADVICE = {
    "CWE-22": ("untrusted data decides a file path", "resolve the path and check that it stays inside an allowed folder"),
    "CWE-78": ("untrusted data reaches a command", "pass arguments as a list to a fixed program, without a shell"),
    "CWE-79": ("untrusted data is written into a page", "escape it for its place in the page, or use a text-only API"),
    "CWE-89": ("untrusted data becomes part of a query", "use placeholders and pass values separately"),
    "CWE-94": ("untrusted data is run as code", "don't build code from data; choose among known functions"),
    "CWE-113": ("untrusted data reaches a response header", "allow only known values and drop line breaks"),
    "CWE-502": ("untrusted data is deserialised", "use a data-only format and validate it"),
    "CWE-601": ("untrusted data decides where to redirect", "redirect to known targets only"),
    "CWE-918": ("untrusted data decides where a request goes", "check the host against a list of allowed ones"),
    "CWE-943": ("untrusted data becomes part of a document query", "check types and drop operators before querying"),
}

RULE_SCHEMAS = {
    "sources": "ord int, id string, kinds array<string>, member string, identifier string, call string, within_functions array<string>, description string",
    "sanitizers": "ord int, id string, member string, identifier string, call string, kinds array<string>, validation string, description string",
    "sinks": "ord int, id string, member string, identifier string, call string, kinds array<string>, severity string, tainted_args array<int>, cwe array<string>, message string, advice string",
    "propagators": "ord int, member string, identifier string, call string, allow_dynamic boolean",
}


def _rows(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.strip().splitlines()]


def _pattern(text: str) -> dict[str, str | None]:
    given = dict(part.split("=", 1) for part in text.split())
    return {k: given.get(k) for k in ("member", "identifier", "call")}


def _tags(text: str) -> list[str]:
    return list(GROUPS.get(text) or text.split(","))


def builtin_sources() -> list[dict]:
    return [{"id": i, **_pattern(p), "kinds": _tags(k), "within_functions": None, "description": f"{i.replace('-', ' ')} is under outside control"} for i, p, k in _rows(SOURCES)]


def builtin_sanitizers() -> list[dict]:
    return [{"id": i, **_pattern(p), "kinds": _tags(k), "validation": v, "description": None} for i, p, k, v in _rows(SANITIZERS)]


def builtin_sinks() -> list[dict]:
    out = []
    for i, p, k, severity, args, cwe in _rows(SINKS):
        weaknesses = cwe.split(", ")
        message, advice = ADVICE[weaknesses[0]]
        out.append({"id": i, **_pattern(p), "kinds": _tags(k), "severity": severity, "tainted_args": None if args == "all" else [int(x) for x in args.split(",")], "cwe": weaknesses, "message": message, "advice": advice})
    return out


def builtin_propagators() -> list[dict]:
    return [{**_pattern(line), "allow_dynamic": False} for line in PROPAGATORS.strip().splitlines()]


def builtin_rules() -> dict[str, list[dict]]:
    return {"sources": builtin_sources(), "sanitizers": builtin_sanitizers(), "sinks": builtin_sinks(), "propagators": builtin_propagators()}


def rule_tables(spark: SparkSession, rules: dict[str, list[dict]]) -> dict[str, DataFrame]:
    """The rules as tables, ord being the order of declaration."""
    return {name: spark.createDataFrame([r | {"ord": k} for k, r in enumerate(rules[name])], schema) if rules[name] else spark.createDataFrame([], schema) for name, schema in RULE_SCHEMAS.items()}
