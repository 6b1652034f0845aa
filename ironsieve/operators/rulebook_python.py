"""Rules for Python: its web frameworks, clients, data readers and tools. Patterns are our own; ids name the weakness."""

from __future__ import annotations

from ironsieve.operators.rules import Rule

_PY = ("python",)
_REQ = r"(?:request|self\.request|flask\.request)\.(?:GET|POST|args|form|json|data|body|files|FILES|values|query_params|headers|cookies)\b"
_FROM = r"(?:" + _REQ + r"|user_?input\b|f['\"][^'\"]*\{\s*user_?\w*)"
_SQL = r"(?:SELECT|INSERT|UPDATE|DELETE)\b"


def _r(id_, severity, type_, pattern, needs, description, absent="", absent_file="", file=False, tests=True):
    return Rule(id_, pattern, severity, type_, description, "", False, needs, absent, _PY, tests, absent_file, file)


DJANGO = (
    _r("DJANGO_QUERYSET_EXTRA_SQL", "critical", "sql_injection", r"\.extra\s*\([^)]*" + _REQ, ".extra", "SQL from the request"),
    _r("DJANGO_ANNOTATE_RAWSQL_INJECT", "critical", "sql_injection", r"\bannotate\s*\([^\n]*RawSQL\s*\(\s*f['\"]", "RawSQL", "SQL in an f-string"),
    _r("DJANGO_F_EXPRESSION_USER_STRING", "high", "sql_injection", r"\bF\s*\(\s*" + _REQ, "F(", "A field from the request"),
    _r("DJANGO_SUBQUERY_RAW_SQL", "critical", "sql_injection", r"\bSubquery\s*\(\s*RawSQL\s*\(\s*f['\"]", "Subquery", "SQL in an f-string"),
    _r("DJANGO_DEFER_SENSITIVE_FIELDS", "medium", "privacy", r"\.only\s*\([^)]*['\"](?:password|secret|token|ssn)['\"]", ".only", "Secrets are loaded"),
    _r("DJANGO_META_ORDERING_USER_INPUT", "medium", "injection", r"\.order_by\s*\(\s*" + _REQ, ".order_by", "An order from the request"),
    _r("DJANGO_CHARFIELD_NO_MAX_LENGTH", "low", "config", r"\bmodels\.CharField\s*\((?![^)]*max_length)", "CharField", "A text without a limit"),
    _r("DJANGO_FILEFIELD_NO_VALIDATION", "medium", "upload", r"\bmodels\.(?:File|Image)Field\s*\((?![^)]*validators)", "Field", "Every file is taken"),
    _r("DJANGO_JSONFIELD_USER_PATH", "high", "injection", r"\.(?:filter|exclude|get)\s*\(\s*\*\*\s*" + _REQ, "**", "Conditions from the request"),
    _r("DJANGO_GENERIC_FK_NO_VALIDATION", "low", "config", r"\bGenericForeignKey\s*\(", "GenericForeignKey", "A key to any table", absent_file=r"\bdef\s+clean\b|limit_choices_to"),
    _r("DJANGO_BULK_CREATE_NO_UNIQUE", "low", "config", r"\.bulk_create\s*\((?![^)]*(?:ignore|update)_conflicts)", ".bulk_create", "Rows that clash"),
    _r("DJANGO_UPDATE_OR_CREATE_RACE", "low", "race", r"\.update_or_create\s*\(", ".update_or_create", "Two writers make two rows", absent_file=r"select_for_update|transaction\.atomic"),
    _r("DJANGO_SELECT_FOR_UPDATE_NO_TIMEOUT", "low", "race", r"\.select_for_update\s*\((?![^)]*(?:nowait|skip_locked))", ".select_for_update", "A lock without end"),
    _r("DJANGO_AGGREGATE_USER_FIELD", "high", "injection", r"\b(?:Sum|Avg|Count|Min|Max)\s*\(\s*" + _REQ, "aggregate", "A field from the request"),
    _r("DJANGO_VALUES_LIST_SENSITIVE", "medium", "privacy", r"\.values(?:_list)?\s*\([^)]*['\"](?:password|secret|token|ssn)['\"]", ".values", "Secrets are listed"),
    _r("DJANGO_FORMVIEW_NO_CSRF", "high", "csrf", r"@(?:method_decorator\s*\(\s*)?csrf_exempt[\s\S]{0,200}?class\s+\w+\s*\(\s*\w*FormView", "csrf_exempt", "A form without protection against forged requests", file=True),
    _r("DJANGO_MODELFORM_EXCLUDE", "medium", "mass_assignment", r"\bModelForm\b[\s\S]{0,300}?\bexclude\s*=", "ModelForm", "All fields but some", file=True),
    _r("DJANGO_STREAMING_USER_CONTENT", "medium", "xss", r"\bStreamingHttpResponse\s*\(\s*" + _REQ, "StreamingHttpResponse", "The request is sent back"),
    _r("DJANGO_RESPONSE_USER_CONTENT_TYPE", "medium", "header_injection", r"\bcontent_type\s*=\s*" + _REQ, "content_type", "A type from the request"),
    _r("DJANGO_REDIRECT_USER_URL", "medium", "open_redirect", r"\b(?:redirect|HttpResponseRedirect)\s*\(\s*" + _REQ, "edirect", "A redirect from the request"),
    _r("DJANGO_LOGINVIEW_NO_RATE_LIMIT", "medium", "auth", r"\bclass\s+\w+\s*\([^)]*\bLoginView\b", "LoginView", "Attempts to log in are not limited", absent_file=r"(?i)ratelimit|axes|throttl"),
    _r("DJANGO_ADMIN_NO_2FA", "low", "auth", r"\badmin\.site\.urls\b", "admin.site.urls", "The administration asks one factor", absent_file=r"(?i)otp|two_factor|2fa"),
    _r("DJANGO_PERMISSION_NO_LOGIN_URL", "low", "auth", r"@permission_required\s*\((?![^)]*(?:login_url|raise_exception))", "permission_required", "No way to log in"),
    _r("DJANGO_CACHE_PAGE_AUTHENTICATED", "high", "privacy", r"@cache_page\b[^\n]*\n\s*@login_required|@login_required\b[^\n]*\n\s*@cache_page", "cache_page", "Private pages in a cache", file=True),
    _r("DJANGO_JSONRESPONSE_MODEL_INSTANCE", "medium", "privacy", r"\bJsonResponse\s*\([^)]*\.__dict__", "JsonResponse", "All fields are sent"),
    _r("DJANGO_SIMPLE_UPLOADED_NO_TYPE_CHECK", "medium", "upload", r"\brequest\.FILES\s*\[", "request.FILES", "Every file is taken", absent_file=r"content_type|validat|magic\."),
    _r("DJANGO_SECRET_KEY_HARDCODED", "critical", "hardcoded_secret", r"^\s*SECRET_KEY\s*=\s*['\"][^'\"]{8,}['\"]", "SECRET_KEY", "The secret key is written into the code"),
    _r("PYTHON_DJANGO_DEBUG", "medium", "config", r"^\s*DEBUG\s*=\s*True\b", "DEBUG", "Debug mode", absent_file=r"\bflask\b"),
)

FLASK = (
    _r("FLASK_BLUEPRINT_NO_AUTH", "medium", "auth", r"=\s*Blueprint\s*\(", "Blueprint", "Routes without a check", absent_file=r"(?i)login_required|jwt_required|auth"),
    _r("FLASK_LOGIN_NO_SESSION_PROTECTION", "low", "auth", r"\bLoginManager\s*\(", "LoginManager", "Sessions move freely", absent_file=r"session_protection"),
    _r("FLASK_WTF_CSRF_DISABLED", "high", "csrf", r"\bWTF_CSRF_ENABLED\b['\"\]]*\s*=\s*False", "WTF_CSRF_ENABLED", "Forms without protection against forged requests"),
    _r("FLASK_SQLALCHEMY_RAW_SQL", "critical", "sql_injection", r"\bsession\.execute\s*\(\s*f['\"]", "session.execute", "SQL in an f-string"),
    _r("FLASK_MAIL_NO_TLS", "medium", "tls", r"\bMAIL_USE_(?:TLS|SSL)\b['\"\]]*\s*=\s*False", "MAIL_USE_", "Unencrypted mail"),
    _r("FLASK_CORS_CREDENTIALS_WILDCARD", "high", "cors", r"\bCORS\s*\((?=[^)]*origins\s*=\s*\[?['\"]\*)(?=[^)]*supports_credentials\s*=\s*True)", "CORS", "Every origin with cookies"),
    _r("FLASK_SEND_FROM_DIR_USER_SUBPATH", "high", "path_traversal", r"\bsend_from_directory\s*\([^)]*" + _REQ, "send_from_directory", "A path from the request"),
    _r("FLASK_LIMITER_NOT_GLOBAL", "low", "config", r"\bLimiter\s*\((?![^)]*default_limits)", "Limiter", "No limit by default"),
    _r("FLASK_ERRORHANDLER_TRACEBACK", "medium", "privacy", r"\btraceback\.format_exc\s*\(", "traceback.format_exc", "Errors are shown in full", absent=r"(?i)log"),
    _r("FLASK_SESSION_FILESYSTEM_BACKEND", "low", "config", r"\bSESSION_TYPE\b['\"\]]*\s*=\s*['\"]filesystem['\"]", "SESSION_TYPE", "Sessions on one machine's disk"),
    _r("FLASK_MIGRATE_USER_REVISION", "high", "injection", r"\b(?:upgrade|downgrade)\s*\(\s*" + _REQ, "grade(", "A revision from the request"),
    _r("FLASK_SESSION_COOKIE_NO_SIGNING", "medium", "cookie", r"\bsession\.sid\s*=|SESSION_USE_SIGNER['\"\]]*\s*=\s*False", ("session.sid", "SESSION_USE_SIGNER"), "Sessions are not signed"),
)

FASTAPI = (
    _r("FASTAPI_NO_MIDDLEWARE_STACK", "low", "config", r"=\s*FastAPI\s*\(", "FastAPI", "No middleware", absent_file=r"add_middleware|middleware\s*="),
    _r("FASTAPI_TRUSTED_HOST_MISSING", "low", "config", r"=\s*FastAPI\s*\(", "FastAPI", "Every host name is served", absent_file=r"TrustedHostMiddleware"),
    _r("FASTAPI_NO_CORS_MIDDLEWARE", "info", "config", r"=\s*FastAPI\s*\(", "FastAPI", "No rule for foreign origins", absent_file=r"CORSMiddleware"),
    _r("FASTAPI_DEPENDS_NO_ERROR_HANDLING", "low", "logic", r"\bdef\s+get_\w+\s*\([^)]*\)[^:]*:\s*(?:(?!\btry\b|\bdef\b)[\s\S])*?\byield\b", "yield", "A resource that an error leaves open", absent_file=r"\bfinally\b|\bwith\b", file=True),
    _r("PYDANTIC_MODEL_NO_VALIDATORS", "low", "validation", r"\bclass\s+\w+\s*\(\s*BaseModel\s*\)\s*:(?=[\s\S]*@\w+\.(?:post|put|patch)\s*\()(?=[\s\S]*\b(?:password|email)\s*:\s*str\b)", "BaseModel", "Foreign data of any form", absent_file=r"validator|Field\s*\(|EmailStr|constr", file=True),
    _r("FASTAPI_BACKGROUND_TASK_USER_FUNC", "high", "code_injection", r"\badd_task\s*\(\s*getattr\s*\(", "add_task", "A function by the request's name"),
    _r("SQLMODEL_RAW_SQL", "critical", "sql_injection", r"\bsession\.exec\s*\(\s*f['\"]", "session.exec", "SQL in an f-string"),
    _r("FASTAPI_WEBSOCKET_NO_AUTH", "high", "auth", r"\bdef\s+\w+\s*\(\s*websocket\s*:\s*WebSocket[^)]*\)", "WebSocket", "A socket for everyone", absent_file=r"(?i)token|Depends|auth|cookie"),
    _r("PYDANTIC_ARBITRARY_TYPES", "low", "validation", r"\barbitrary_types_allowed\s*=\s*True", "arbitrary_types_allowed", "Types that nobody checks"),
    _r("FASTAPI_MOUNT_NO_PATH_VALIDATION", "medium", "path_traversal", r"\.mount\s*\(\s*f['\"][^'\"]*\{", ".mount", "A path from values"),
    _r("FASTAPI_RESPONSE_USER_HEADERS", "medium", "header_injection", r"\bheaders\s*=\s*request\.headers\b", "headers", "Headers from the request"),
    _r("STARLETTE_MIDDLEWARE_NO_EXCEPTION", "low", "logic", r"\bclass\s+\w+\s*\(\s*BaseHTTPMiddleware\s*\)", "BaseHTTPMiddleware", "Errors pass by", absent_file=r"\btry\b"),
    _r("UVICORN_RELOAD_PRODUCTION", "low", "config", r"\buvicorn\.run\s*\([^)]*\breload\s*=\s*True", "uvicorn.run", "A server that reloads"),
)

CLIENTS = (
    _r("ASYNCIO_SUBPROCESS_SHELL_TRUE", "critical", "command_injection", r"\bcreate_subprocess_shell\s*\(\s*(?:f['\"]|\w+\s*[+%)])", "create_subprocess_shell", "A shell command from values"),
    _r("AIOFILES_USER_PATH", "high", "path_traversal", r"\baiofiles\.open\s*\(\s*" + _FROM, "aiofiles.open", "A path from the request"),
    _r("ASYNCPG_UNSAFE_QUERY", "critical", "sql_injection", r"(?i)\.(?:fetch|fetchrow|fetchval|execute)\s*\(\s*f['\"]\s*" + _SQL, "(", "SQL in an f-string"),
    _r("AIOREDIS_USER_KEY", "medium", "injection", r"\bredis\.\w+\s*\(\s*" + _FROM, "redis.", "A key from the request"),
    _r("TRIO_TCP_NO_TLS", "medium", "tls", r"\btrio\.open_tcp_stream\s*\(", "open_tcp_stream", "An unencrypted connection", absent_file=r"SSLStream|ssl_over_tcp"),
    _r("AIOHTTP_SESSION_NO_TIMEOUT", "low", "config", r"\bClientSession\s*\((?![^)]*timeout)", "ClientSession", "A request without end"),
    _r("ASYNCIO_LOCK_NO_TIMEOUT", "low", "race", r"\bawait\s+\w*lock\w*\.acquire\s*\(\s*\)", "acquire", "A lock without end", absent=r"wait_for"),
    _r("CONCURRENT_FUTURES_USER_EXECUTOR", "high", "code_injection", r"\.submit\s*\(\s*getattr\s*\(", ".submit", "A function by a foreign name"),
    _r("REQUESTS_NO_TIMEOUT", "low", "config", r"\brequests\.(?:get|post|put|patch|delete|head)\s*\((?![^\n]*timeout)", "requests.", "A request without end"),
    _r("URLLIB3_DISABLED_WARNINGS", "low", "tls", r"\burllib3\.disable_warnings\s*\(", "disable_warnings", "Warnings are off"),
    _r("SELENIUM_USER_URL", "high", "ssrf", r"\bdriver\.get\s*\(\s*" + _FROM, "driver.get", "An address from the request"),
    _r("BEAUTIFULSOUP_LXML_UNTRUSTED_XML", "medium", "xxe", r"\bBeautifulSoup\s*\([^)]*['\"](?:lxml-xml|xml)['\"]", "BeautifulSoup", "Foreign XML"),
    _r("PARAMIKO_EXEC_USER_INPUT", "critical", "command_injection", r"\bexec_command\s*\(\s*(?:f['\"]|" + _REQ + ")", "exec_command", "A remote command from values"),
    _r("PARAMIKO_NO_HOST_KEY_VERIFY", "high", "tls", r"\b(?:AutoAdd|Warning)Policy\b", "Policy", "Every host is trusted"),
    _r("FTPLIB_NO_TLS", "medium", "tls", r"\bftplib\.FTP\s*\(", "ftplib.FTP", "Unencrypted transfer"),
    _r("SOCKET_BIND_ALL_INTERFACES", "low", "config", r"\.bind\s*\(\s*\(\s*['\"](?:0\.0\.0\.0)?['\"]", ".bind", "All networks are served"),
    _r("HTTPLIB2_NO_CERT_VERIFY", "high", "tls", r"\bdisable_ssl_certificate_validation\s*=\s*True", "disable_ssl_certificate_validation", "Certificates aren't checked"),
    _r("DNS_RESOLVER_USER_QUERY", "medium", "ssrf", r"\bresolver\.(?:resolve|query)\s*\(\s*" + _FROM, "resolver.", "A name from the request"),
    _r("BOTO3_NO_REGION_VALIDATION", "medium", "cloud", r"\bregion_name\s*=\s*" + _REQ, "region_name", "A region from the request"),
    _r("DOCKER_PY_USER_IMAGE", "critical", "command_injection", r"\bcontainers\.run\s*\(\s*" + _REQ, "containers.run", "An image from the request"),
    _r("K8S_CLIENT_USER_NAMESPACE", "high", "cloud", r"\bnamespace\s*=\s*" + _REQ, "namespace", "A namespace from the request"),
    _r("CELERY_TASK_USER_ARGS", "high", "code_injection", r"\bsend_task\s*\(\s*" + _REQ, "send_task", "A task by the request's name"),
    _r("FABRIC_INVOKE_USER_CMD", "critical", "command_injection", r"\b(?:c|conn|connection|ctx)\.(?:run|sudo|local)\s*\(\s*f['\"]", "fabric", "A remote command from values", file=True),
    _r("GUNICORN_DEBUG_MODE", "low", "config", r"\bloglevel\s*=\s*['\"]debug['\"]", "loglevel", "Debug logs"),
)

CRYPTO = (
    _r("CRYPTOGRAPHY_UNSAFE_PARAMS", "high", "weak_crypto", r"\bgenerate_private_key\s*\([^)]*key_size\s*=\s*(?:512|768|1024)\b", "generate_private_key", "A short key"),
    _r("PYJWT_NO_ALGORITHM_VERIFY", "high", "auth", r"\bjwt\.decode\s*\((?![^)]*algorithms)", "jwt.decode", "A token of any algorithm"),
    _r("PYTHON_JOSE_NONE_ALGORITHM", "critical", "auth", r"\balgorithms\s*=\s*\[[^\]]*['\"]none['\"]", "algorithms", "Unsigned tokens are taken"),
    _r("PASSLIB_DEPRECATED_SCHEME", "high", "weak_crypto", r"\b(?:passlib\.hash\.)?(?:md5_crypt|des_crypt|sha1_crypt|ldap_md5|lmhash|nthash)\b", "crypt", "A weak hash over passwords"),
    _r("ITSDANGEROUS_SHORT_SECRET", "high", "hardcoded_secret", r"\b(?:URLSafe(?:Timed)?|Timed|JSONWebSignature)?Serializer\s*\(\s*['\"][^'\"]+['\"]", "Serializer", "A signing secret is written into the code"),
    _r("BCRYPT_LOW_ROUNDS", "medium", "weak_crypto", r"\bgensalt\s*\(\s*(?:rounds\s*=\s*)?[1-9]\s*\)", "gensalt", "Too few rounds"),
    _r("FERNET_HARDCODED_KEY", "critical", "hardcoded_secret", r"\bFernet\s*\(\s*b?['\"][A-Za-z0-9_=+/-]{16,}['\"]", "Fernet", "A key is written into the code"),
    _r("SSL_WEAK_PROTOCOL", "high", "tls", r"\bPROTOCOL_(?:SSLv2|SSLv3|SSLv23|TLSv1|TLSv1_1)\b", "PROTOCOL_", "A weak protocol"),
)

DATA = (
    _r("PANDAS_READ_CSV_USER_PATH", "high", "path_traversal", r"\b(?:pd|pandas)\.read_(?:csv|excel|json|table)\s*\(\s*" + _FROM, ".read_", "A path from the request"),
    _r("PARQUET_USER_SCHEMA", "high", "path_traversal", r"\bread_parquet\s*\(\s*" + _FROM, "read_parquet", "A path from the request"),
    _r("OPENPYXL_MACRO_ENABLED", "medium", "code_injection", r"\bkeep_vba\s*=\s*True", "keep_vba", "Macros are kept"),
    _r("PIL_IMAGE_BOMB", "medium", "dos", r"\bMAX_IMAGE_PIXELS\s*=\s*None", "MAX_IMAGE_PIXELS", "Images of any size"),
    _r("CSV_READER_NO_FIELD_SIZE_LIMIT", "low", "dos", r"\bcsv\.(?:reader|DictReader)\s*\(", "csv.", "Fields of any size", absent_file=r"field_size_limit"),
    _r("JSON_LOADS_NO_SIZE_LIMIT", "low", "dos", r"\bjson\.loads?\s*\(\s*" + _REQ, "json.load", "A request of any size"),
    _r("YAML_LOAD_UNSAFE_LOADER", "high", "deserialization", r"\byaml\.(?:unsafe_load|load)\s*\((?![^)]*(?:SafeLoader|CSafeLoader))", "yaml.", "Objects from YAML"),
    _r("SQLITE3_USER_DB_PATH", "high", "path_traversal", r"\bsqlite3\.connect\s*\(\s*" + _FROM, "sqlite3.connect", "A path from the request"),
    _r("H5PY_UNTRUSTED_HDF5", "medium", "deserialization", r"\bh5py\.File\s*\(\s*" + _FROM, "h5py.File", "A foreign file"),
    _r("XLRD_FORMULA_EVAL", "medium", "deserialization", r"\bxlrd\.open_workbook\s*\(\s*" + _FROM, "open_workbook", "A foreign workbook"),
    _r("PYTEST_FIXTURE_REAL_CREDS", "medium", "hardcoded_secret", r"@pytest\.fixture[\s\S]{0,200}?\b(?:password|secret|token|api_key)\s*=\s*['\"][^'\"\s]{8,}['\"]", "pytest.fixture", "A secret in a test", file=True, tests=False),
    _r("UNITTEST_MOCK_SIDE_EFFECT_EXEC", "high", "code_injection", r"\bside_effect\s*=\s*(?:eval|exec|compile)\b", "side_effect", "A test runs code from data", tests=False),
)

RULES = DJANGO + FLASK + FASTAPI + CLIENTS + CRYPTO + DATA
