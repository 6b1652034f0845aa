"""Rules for servers, browsers and cloud functions in JavaScript and TypeScript. Patterns are our own; ids name the weakness.

``file`` rules look at whole texts: what they find may span lines, and ``absent_file`` names what makes it harmless."""

from __future__ import annotations

from ironsieve.operators.rules import Rule

_JS = ("javascript", "typescript")
_REQ = r"(?:req|request|ctx|event)\.(?:body|query|params|headers)\b"


def _r(id_, severity, type_, pattern, needs, description, absent="", absent_file="", file=False, fixable=False):
    return Rule(id_, pattern, severity, type_, description, "", fixable, needs, absent, _JS, True, absent_file, file)


SERVER = (
    _r("COOKIE_NO_SIGNED_OPTION", "low", "cookie", r"\bcookieParser\s*\(\s*\)", "cookieParser", "Cookies are not signed"),
    _r("DOUBLE_CALLBACK_MIDDLEWARE", "medium", "logic", r"(?<!return )\bnext\s*\(\s*\)\s*;\s*(?:res|ctx)\.\w+", "next(", "A response after the next handler was called"),
    _r("HELMET_MISSING_HSTS_MAXAGE", "low", "config", r"\bhsts\s*\(?\s*:?\s*\{[^}]*maxAge\s*:\s*\d{1,7}\b", "hsts", "A short age for strict transport"),
    _r("HELMET_MISSING_REFERRER_POLICY", "low", "config", r"\breferrerPolicy\s*:\s*false", "referrerPolicy", "No referrer policy"),
    _r("HELMET_MISSING_XCTO", "low", "config", r"\bnoSniff\s*:\s*false", "noSniff", "Content types are sniffed"),
    _r("FASTIFY_NO_BODY_LIMIT", "low", "config", r"\b[fF]astify\s*\(\s*(?:\{(?![^}]*bodyLimit)[^}]*\})?\s*\)", "astify", "No limit on a request's size"),
    _r("KOA_NO_BODY_LIMIT", "low", "config", r"\bkoaBody\s*\(\s*(?:\)|\{(?![^}]*[lL]imit))", "koaBody", "No limit on a request's size"),
    _r("CONFIG_NO_SECURITY_HEADERS", "low", "config", r"=\s*express\s*\(\s*\)", "express", "No security headers", absent_file=r"\bhelmet\b"),
    _r("MISSING_CSRF_PROTECTION", "medium", "csrf", r"\b(?:app|router)\.(?:post|put|patch|delete)\s*\(\s*['\"`]", "express", "A form without protection against forged requests", absent_file=r"(?i)\b(?:csrf|csurf|lusca)\b|\bBearer\b", file=True),
    _r("RATE_LIMIT_AUTH_ENDPOINT", "medium", "auth", r"\b(?:app|router)\.post\s*\(\s*['\"`][^'\"`]*(?:login|signin|auth|register|password)", ".post", "Attempts to log in are not limited", absent_file=r"(?i)rate-?limit|limiter|throttl"),
    _r("AUTH_MISSING_AUTH_MIDDLEWARE", "high", "auth", r"\b(?:app|router)\.(?:get|post|put|patch|delete)\s*\(\s*['\"`][^'\"`]*(?:admin|internal|private)[^'\"`]*['\"`]\s*,\s*(?:async\s*)?\(", "(", "A protected path without a check", absent=r"(?i)auth|verify|session"),
    _r("LOGIN_NO_LOCKOUT", "medium", "auth", r"\b(?:app|router)\.post\s*\(\s*['\"`][^'\"`]*/(?:login|signin)['\"`]", ".post", "Failed attempts to log in are not counted", absent_file=r"(?i)limiter|rateLimit|lockout|attempts|throttl"),
    _r("SSO_CALLBACK_NO_STATE", "high", "auth", r"\b(?:app|router)\.get\s*\(\s*['\"`][^'\"`]*(?:callback|oauth)[^'\"`]*['\"`]", "callback", "A sign-on callback without its state", absent_file=r"\bstate\b"),
    _r("PASSWORD_RESET_TOKEN_NO_TTL", "medium", "auth", r"(?i)\breset_?token\s*=\s*[^;\n]*(?:random|uuid|nanoid)", "eset", "A reset token that never expires", absent_file=r"(?i)expir|\bttl\b|maxAge"),
    _r("TWO_FA_BACKUP_CODES_UNHASHED", "high", "auth", r"(?i)\b(?:backup|recovery)_?codes\s*[:=]\s*\[\s*['\"`]", "odes", "Backup codes as plain text"),
    _r("SERVICE_ACCOUNT_ADMIN", "high", "auth", r"(?i)service_?account\b[^\n]*\brole\s*:\s*['\"](?:admin|owner|root|superuser)", "ccount", "A service with all rights"),
    _r("AUTH_PLAINTEXT_PASSWORD_STORAGE", "high", "auth", r"(?i)\bpassword\s*=\s*['\"][^'\"\s]{8,}['\"]", "assword", "A password as plain text", absent=r"process\.env|import\.meta\.env"),
    _r("TIMING_UNSAFE_COMPARISON", "medium", "auth", r"(?i)\bif\s*\(\s*\w*(?:signature|hmac|digest|secret|token)\w*\s*!?==?=?\s*\w*(?:signature|hmac|digest|secret|token)\w*", "if", "Secrets are compared in varying time", absent_file=r"timingSafeEqual"),
    _r("WEAK_RANDOM_SEED", "medium", "weak_random", r"(?i)\bseed\s*[:=]\s*(?:Date\.now\s*\(|new Date|process\.pid|Math\.random)", "eed", "A seed that can be guessed"),
    _r("CRYPTO_CTR_NO_MAC", "medium", "weak_crypto", r"createCipheriv\s*\(\s*['\"]aes-\d+-ctr['\"]", "createCipheriv", "A stream cipher without authentication", absent_file=r"createHmac|getAuthTag"),
    _r("PBKDF2_LOW_ITERATION_COUNT", "medium", "weak_crypto", r"\bpbkdf2(?:Sync)?\s*\([^,]+,[^,]+,\s*\d{1,5}\s*,", "pbkdf2", "Too few rounds"),
    _r("SNI_MISMATCH_IGNORE", "high", "tls", r"checkServerIdentity\s*:\s*(?:\([^)]*\)|\w+)\s*=>\s*(?:undefined|null|true|\{\s*\})", "checkServerIdentity", "The server's name isn't checked"),
    _r("REDIRECT_CHAIN_NO_LIMIT", "low", "ssrf", r"\baxios\.create\s*\(\s*\{(?![^}]*maxRedirects)", "axios.create", "Redirects are followed without limit"),
    _r("WEBSOCKET_UPGRADE_NO_AUTH", "high", "auth", r"\.on\s*\(\s*['\"]upgrade['\"]", "upgrade", "A socket is opened for everyone", absent_file=r"(?i)verify|token|auth|session|cookie"),
    _r("EMAIL_TEMPLATE_USER_HTML", "medium", "xss", r"\bhtml\s*:\s*(?:`[^`]*\$\{\s*)?" + _REQ, "html", "A mail's markup from the request"),
    _r("BACKUP_NO_ENCRYPTION", "medium", "privacy", r"\b(?:pg_dump|mysqldump|mongodump)\b", "dump", "A backup as plain text", absent=r"(?i)gpg|openssl|encrypt|\bage\b|kms"),
    _r("RECURSIVE_NO_DEPTH_LIMIT", "low", "logic", r"\bfunction\s+(\w+)\s*\(\s*(?:node|tree|obj)\s*\)\s*\{[^}]*\b\1\s*\(", "function", "Recursion over foreign data without limit", absent=r"(?i)depth|reduce|\.map"),
    _r("CMD_INJECTION_EXEC_CONCAT", "critical", "command_injection", r"(?<![\w.])(?:child_process\.|cp\.)?exec(?:Sync)?\s*\(\s*['\"][^'\"]*['\"]\s*\+", "exec", "A shell command from values"),
    _r("EVAL_USER_INPUT", "critical", "code_injection", r"(?<![\w.])eval\s*\(\s*(?:\w*[iI]nput\w*|" + _REQ + ")", "eval", "Code from the request"),
    _r("MONITORING_BLIND_SPOT_ERROR", "low", "logic", r"\bcatch\s*(?:\(\s*\w+\s*\))?\s*\{\s*\}", "catch", "An error that nobody learns of", file=True),
    _r("UPLOAD_MIME_ONLY_CHECK", "medium", "upload", r"\bmime_?[tT]ype\s*(?:\.startsWith\s*\(|===?)\s*['\"]", "ime", "A type that the sender claims", absent_file=r"(?i)magic|fileType|file-type|signature"),
    _r("TS_UNKNOWN_NO_NARROWING", "low", "types", r"\bunknown\b[^\n]*(?i:jwt|token|session|user|auth)[^\n]*\bas\s+[A-Z]\w*", "unknown", "Foreign data is believed to have a type", absent=r"JSON\.parse|instanceof|typeof"),
    _r("FETCH_NO_ERROR_HANDLING", "info", "logic", r"\bawait\s+fetch\s*\(", "fetch", "A request without handling of errors", absent_file=r"\bcatch\b|\.ok\b|[Ee]rror|Wrapper"),
    _r("API_KEY_LITERAL_REACT", "high", "hardcoded_secret", r"(?i)\bapi_?key\s*=\s*['\"](?:sk|pk|key)-[A-Za-z0-9]{12,}", "ey", "A key that browsers get"),
)

DATABASE = (
    _r("SQL_INJECTION_INLINE_VAR", "critical", "sql_injection", r"(?i)\b(?:const|let|var)\s+\w+\s*=\s*['\"]\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^\"\n]*['\"]\s*\+", "=", "SQL is put together from strings"),
    _r("SQL_INJECTION_ORM_RAW", "critical", "sql_injection", r"\.(?:raw|literal|queryRawUnsafe|executeRawUnsafe)\s*\(\s*(?:`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+)", "(", "Raw SQL from values"),
    _r("TEMPLATE_LITERAL_SQL_VARIABLE", "high", "sql_injection", r"(?i)=\s*`\s*(?:SELECT|INSERT INTO|UPDATE|DELETE FROM)\b[^`]*\$\{", "${", "SQL template with values"),
    _r("PRISMA_RAW_UNSAFE", "critical", "sql_injection", r"\$(?:queryRaw|executeRaw)Unsafe\s*\(", "RawUnsafe", "Raw query without parameters"),
    _r("N_PLUS_ONE_QUERY", "low", "performance", r"\bfor\s*(?:await\s*)?\([^)]*\)\s*\{[^}]*\bawait\s+\w+(?:\.\w+)*\.(?:find\w*|query|get)\s*\(", "await", "A query for each element", file=True),
    _r("REDIS_PUBSUB_UNVALIDATED_CHANNEL", "medium", "injection", r"\.p?(?:subscribe|publish)\s*\(\s*" + _REQ, "ub", "A channel from the request"),
    _r("DB_RESULT_DIRECT_RESPONSE", "medium", "privacy", r"\b(\w+)\s*=\s*await\s+[^\n]*\.(?:query|find\w*|execute)\s*\([^\n]*\)\s*;?\s*\n\s*(?:return\s+)?res\.(?:json|send)\s*\(\s*\1\s*\)", "await", "Whole rows are sent", file=True),
    _r("DATA_RETENTION_NO_TTL", "low", "privacy", r"\bredis\.set\s*\(\s*['\"`][^'\"`]*(?:user|session|profile|customer)[^'\"`]*['\"`]\s*,(?![^;\n]*(?:['\"](?:EX|PX)['\"]|ttl|expire))", "redis.set", "Personal data that never expires"),
    _r("CACHE_KEY_PII", "medium", "privacy", r"\bcache\.\w+\s*\(\s*['\"`][^'\"`]*(?:email|ssn|phone)\b", "cache.", "Personal data in a key"),
    _r("SQS_MESSAGE_NO_VALIDATION", "medium", "injection", r"\bJSON\.parse\s*\(\s*(?:record|message|msg)\.[bB]ody\s*\)", "JSON.parse", "A message is believed unread", absent_file=r"(?i)schema|validat|\bzod\b|\.parse\s*\(\s*(?!record|message|msg)\w+\s*\)"),
)

PROMPTS = (
    _r("PROMPT_INJECTION_API_UNSANITIZED", "high", "prompt_injection", r"(?:completions|messages|chat)\.create\s*\([\s\S]{0,400}?content\s*:\s*(?:`[^`]*\$\{\s*)?" + _REQ, ".create", "Request text goes to a model as it is", absent_file=r"(?i)\bsanitiz\w*\s*\(", file=True),
    _r("PROMPT_INJECTION_NO_INPUT_LIMIT", "medium", "prompt_injection", r"(?:completions|messages|chat)\.create\s*\([\s\S]{0,400}?content\s*:\s*(?:`[^`]*\$\{\s*)?" + _REQ, ".create", "Request text of any length goes to a model", absent_file=r"\.length\s*[<>]|\.slice\s*\(|\.substring\s*\(|max(?:Length|Tokens)", file=True),
    _r("PROMPT_INJECTION_RAG_UNSANITIZED", "medium", "prompt_injection", r"role\s*:\s*['\"]system['\"]\s*,\s*content\s*:\s*`[^`]*\$\{\s*\w*(?:[cC]ontext|[dD]ocument|[cC]hunk|[rR]etriev)", "system", "Found texts in the system's role"),
)

BROWSER = (
    _r("REACT_DANGEROUSLYSETINNERHTML_VARIABLE", "high", "xss", r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*[A-Za-z_$][\w$.]*\s*\}\}", "dangerouslySetInnerHTML", "Markup from a variable"),
    _r("PWA_LOCALSTORAGE_AUTH", "medium", "auth", r"(?i)\blocalStorage\.setItem\s*\(\s*['\"`]\w*(?:token|jwt|auth|session)", "localStorage", "Tokens where every script reads them"),
    _r("POSTMESSAGE_PARENT_NO_ORIGIN", "medium", "xss", r"\bpostMessage\s*\([^;\n]*,\s*['\"]\*['\"]", "postMessage", "A message for every origin"),
    _r("CLIPBOARD_NO_GESTURE", "low", "privacy", r"\bclipboard\.read(?:Text)?\s*\(", "clipboard", "The clipboard is read unasked", absent_file=r"addEventListener\s*\(\s*['\"](?:click|paste|keydown)|on(?:Click|Paste)\b"),
    _r("INDEXEDDB_SENSITIVE_UNENCRYPTED", "medium", "privacy", r"(?i)\.put\s*\(\s*\{[^}]*\b(?:token|password|secret|ssn)\s*:", ".put", "Secrets in the browser's database", absent=r"(?i)encrypt"),
    _r("SW_CACHE_SENSITIVE", "medium", "privacy", r"\bcache\.(?:put|add)\s*\(\s*['\"`][^'\"`]*(?:auth|session|account|token)", "cache.", "Private answers in a cache"),
    _r("OPEN_REDIRECT_WINDOW", "medium", "open_redirect", r"\bwindow\.location(?:\.href)?\s*=\s*(?:" + _REQ + r"|\w*[pP]arams\.get\s*\()", "window.location", "A redirect from the address"),
    _r("PII_IN_ANALYTICS", "medium", "privacy", r"(?i)\b(?:analytics|mixpanel|amplitude|posthog|gtag)\b[^\n]*\b(?:email|ssn|phone|password)\s*:", "(", "Personal data in analytics"),
    _r("SENTRY_FULL_USER", "low", "privacy", r"\bSentry\.setUser\s*\(\s*\{[^}]*\b(?:email|username|ip_address)\b", "Sentry", "Personal data in error reports"),
    _r("TRACKING_NO_CONSENT", "low", "privacy", r"\b(?:analytics\.init|mixpanel\.init|gtag)\s*\(", "(", "Visitors are tracked unasked", absent_file=r"(?i)consent"),
    _r("COOKIE_NO_SAMESITE", "low", "cookie", r"(?:\bsetCookie|\.cookie)\s*\([^;\n]*\{(?![^}]*sameSite)[^}]*\}", "ookie", "A cookie for foreign pages"),
    _r("COOKIE_MISSING_SAMESITE", "low", "cookie", r"\bres\.cookie\s*\([^;\n]*\{(?![^}]*sameSite)[^}]*\}", "res.cookie", "A cookie for foreign pages"),
)

SERVICES = (
    _r("GRAPHQL_NO_COMPLEXITY_LIMIT", "medium", "graphql", r"new\s+ApolloServer\s*\(", "ApolloServer", "Queries of any depth", absent_file=r"(?i)complexity|depthLimit|depth-limit"),
    _r("GRAPHQL_BATCH_UNLIMITED", "low", "graphql", r"allowBatchedHttpRequests\s*:\s*true(?![^}]*maxBatch)", "allowBatchedHttpRequests", "Batches of any size"),
    _r("GRAPHQL_RESOLVER_ERROR_LEAK", "low", "graphql", r"new\s+GraphQLError\s*\(\s*(?:err|error|e)\.(?:message|stack)", "GraphQLError", "Errors are shown in full"),
    _r("GRAPHQL_INTROSPECTION_INTERNAL", "low", "graphql", r"new\s+ApolloServer\s*\([^)]*introspection\s*:\s*true", "introspection", "The schema is open"),
    _r("GRAPHQL_CIRCULAR_REF", "low", "graphql", r"(?s)\btype\s+(\w+)\s*\{[^}]*:\s*\[?\s*(\w+)[!\]\s][^}]*\}.*\btype\s+\2\s*\{[^}]*:\s*\[?\s*\1[!\]\s]", "type ", "Types that hold each other", absent_file=r"(?m)^\s*(?:import|export|interface)\b", file=True),
    _r("ENV_VARS_IN_RESPONSE", "critical", "privacy", r"\.(?:json|send)\s*\(\s*process\.env\s*\)", "process.env", "The whole environment is sent"),
    _r("EDGE_FUNCTION_DYNAMIC_IMPORT", "high", "code_injection", r"\bimport\s*\(\s*" + _REQ, "import", "A module by the request's name"),
    _r("FUNCTION_URL_NO_AUTH", "high", "cloud", r"\bauth_?[tT]ype\s*:\s*(?:['\"]NONE['\"]|\w+\.NONE\b)", "NONE", "A function that everyone may call"),
    _r("STEP_FUNCTION_USER_STATE", "medium", "cloud", r"startExecution\s*\([^;\n]*JSON\.stringify\s*\(\s*" + _REQ + r"\s*\)", "startExecution", "A workflow's state from the request"),
    _r("NEXT_API_NO_AUTH", "medium", "auth", r"export\s+default\s+(?:async\s+)?function\s+handler\s*\(\s*req", "handler", "An endpoint without a check", absent_file=r"(?i)getServerSession|getToken|withAuth|verify\w*\("),
    _r("NEXT_SERVER_ACTION_NO_AUTH", "high", "auth", r"['\"]use server['\"][\s\S]*?export\s+async\s+function\s+\w+[\s\S]*?\.(?:delete|update|upsert)\w*\s*\(", "use server", "An action without a check", absent_file=r"\bauth\s*\(|getServerSession|currentUser|getUser\s*\(", file=True),
    _r("SERVER_ACTION_NO_CSRF", "low", "csrf", r"['\"]use server['\"][\s\S]*?\ballowedOrigins\s*:\s*\[\s*['\"]\*", "use server", "Actions from every origin", file=True),
    _r("NEXTJS_REDIRECT_USER_INPUT", "medium", "open_redirect", r"(?<![\w.])redirect\s*\(\s*(?:searchParams\b|params\b|" + _REQ + ")", "next/navigation", "A redirect from the request", file=True),
    _r("ON_DEMAND_REVALIDATION_NO_SECRET", "medium", "auth", r"\bres\.(?:revalidate|unstable_revalidate)\s*\(", "evalidate", "Everyone may renew pages", absent_file=r"(?i)secret|token"),
    _r("VERCEL_CRON_NO_AUTH", "medium", "auth", r"export\s+(?:async\s+)?function\s+(?:GET|POST)\s*\(", "cron", "A schedule that everyone may start", absent_file=r"(?i)CRON_SECRET|authorization|verify\w+", file=True),
)

RULES = SERVER + DATABASE + PROMPTS + BROWSER + SERVICES
