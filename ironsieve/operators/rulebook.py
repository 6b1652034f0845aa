"""Rules for secrets and vulnerable code, line by line. Patterns are our own, written against what each rule must and must
not report; ids name the weakness. Rules that need more than one line look at the line that shows it best."""

from __future__ import annotations

from ironsieve.operators import rulebook_python, rulebook_web
from ironsieve.operators.rules import Rule

_USER = r"(?:req(?:uest)?\.(?:body|query|params|headers|cookies)|ctx\.(?:request|query|params)|userInput|user_input|input)\b"


def _r(id_, severity, type_, pattern, description, fix="", needs="", absent="", fixable=False, entropy=0.0):
    return Rule(id_, pattern, severity, type_, description, fix, fixable, needs, absent, entropy=entropy)


#: Formats of issued secrets, as their issuers publish them.
SECRETS = (
    _r("SECRET_AWS_ACCESS_KEY", "critical", "hardcoded_secret", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", "AWS access key", "Use the environment or a role", needs=("AKIA", "ASIA")),
    _r("SECRET_AWS_SECRET_KEY", "critical", "hardcoded_secret", r"(?i)aws_?secret(?:_?access)?_?key['\"]?\s*[:=]\s*['\"][A-Za-z0-9/+=]{40}['\"]", "AWS secret key", needs=("ecret", "ECRET")),
    _r("SECRET_STRIPE_KEY", "critical", "hardcoded_secret", r"\b[sr]k_live_[0-9a-zA-Z]{16,}", "Stripe live key", needs="k_live_"),
    _r("SECRET_STRIPE_WEBHOOK", "critical", "hardcoded_secret", r"\bwhsec_[0-9a-zA-Z]{24,}", "Stripe webhook secret", needs="whsec_"),
    _r("SECRET_GITHUB_TOKEN", "critical", "hardcoded_secret", r"\bgh[pousr]_[A-Za-z0-9]{30,}", "GitHub token", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    _r("SECRET_GITHUB_FINE_GRAINED", "critical", "hardcoded_secret", r"\bgithub_pat_[A-Za-z0-9_]{40,}", "GitHub fine-grained token", needs="github_pat_"),
    _r("SECRET_GITLAB_TOKEN", "critical", "hardcoded_secret", r"\bglpat-[A-Za-z0-9_-]{20,}", "GitLab token", needs="glpat-"),
    _r("SECRET_SLACK_TOKEN", "critical", "hardcoded_secret", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "Slack token", needs="xox"),
    _r("SECRET_SLACK_WEBHOOK", "high", "hardcoded_secret", r"hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]{20,}", "Slack webhook", needs="hooks.slack.com"),
    _r("SECRET_GOOGLE_API_KEY", "critical", "hardcoded_secret", r"\bAIza[0-9A-Za-z_-]{35}", "Google API key", needs="AIza"),
    _r("SECRET_SENDGRID_KEY", "critical", "hardcoded_secret", r"\bSG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", "SendGrid key", needs="SG."),
    _r("SECRET_TWILIO_KEY", "critical", "hardcoded_secret", r"\bSK[0-9a-f]{32}\b", "Twilio key", needs="SK"),
    _r("SECRET_NPM_TOKEN", "critical", "hardcoded_secret", r"\bnpm_[A-Za-z0-9]{36}", "npm token", needs="npm_"),
    _r("SECRET_PYPI_TOKEN", "critical", "hardcoded_secret", r"\bpypi-[A-Za-z0-9_-]{50,}", "PyPI token", needs="pypi-"),
    _r("SECRET_MAILGUN_KEY", "high", "hardcoded_secret", r"\bkey-[0-9a-f]{32}\b", "Mailgun key", needs="key-"),
    _r("SECRET_SQUARE_TOKEN", "critical", "hardcoded_secret", r"\bsq0(?:atp|csp)-[A-Za-z0-9_-]{22,}", "Square token", needs="sq0"),
    _r("SECRET_SHOPIFY_TOKEN", "critical", "hardcoded_secret", r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", "Shopify token", needs="shp"),
    _r("SECRET_DIGITALOCEAN_TOKEN", "critical", "hardcoded_secret", r"\bdo[opr]_v1_[0-9a-f]{64}", "DigitalOcean token", needs="_v1_"),
    _r("SECRET_TELEGRAM_TOKEN", "high", "hardcoded_secret", r"\b\d{8,10}:AA[A-Za-z0-9_-]{33}", "Telegram bot token", needs=":AA"),
    _r("SECRET_JWT", "high", "hardcoded_secret", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "A signed token", needs="eyJ"),
    _r("SECRET_PRIVATE_KEY", "critical", "hardcoded_secret", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY", "A private key", needs="PRIVATE KEY"),
    _r("SECRET_DB_CREDENTIALS", "critical", "hardcoded_secret", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@'\"]+:[^\s@'\"$\{]{3,}@", "Database address with a password", absent=r"localhost|127\.0\.0\.1|example\.com|<password>|process\.env", needs="://"),
    _r("SECRET_BASIC_AUTH_URL", "high", "hardcoded_secret", r"https?://[^\s:/@'\"]+:[^\s@'\"$\{]{6,}@", "Address with a password", absent=r"localhost|example\.com", needs="://"),
    _r("SECRET_GENERIC_API_KEY", "high", "hardcoded_secret", r"(?i)\b(?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token|client[_-]?secret)['\"]?\s*[:=]\s*['\"][A-Za-z0-9_\-]{20,}['\"]", "A key is written into the code", absent=r"(?i)process\.env|os\.environ|getenv|example|placeholder|your[_-]|xxxx|changeme", entropy=3.0, needs=("key", "Key", "KEY", "oken", "OKEN", "ecret", "ECRET")),
    _r("SECRET_GENERIC_PASSWORD", "high", "hardcoded_secret", r"(?i)\b(?:password|passwd|pwd)['\"]?\s*[:=]\s*['\"][^'\"\s]{8,}['\"]", "A password is written into the code", absent=r"(?i)process\.env|os\.environ|getenv|example|placeholder|your[_-]|xxxx|changeme|\$\{|<", needs=("assw", "ASSW", "pwd", "PWD", "Pwd")),
    _r("AUTH_JWT_HARDCODED_SECRET", "critical", "hardcoded_secret", r"jwt\.(?:sign|verify)\s*\([^)]*,\s*['\"][^'\"]{3,}['\"]", "A signing secret is written into the code", needs="jwt."),
)

#: Weaknesses in code.
VULNERABILITIES = (
    _r("SQL_INJECTION_CONCAT", "critical", "sql_injection", r"(?i)(?:\"\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^\"]*\"|'\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^']*'|`\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^`]*`)\s*\+\s*\w", "SQL is put together from strings", "Use parameters", fixable=True, needs="+"),
    _r("SQL_INJECTION_TEMPLATE", "critical", "sql_injection", r"(?i)\.(?:query|execute|raw|run)\s*\(\s*`[^`]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^`]*\$\{", "SQL template with values", "Use parameters", fixable=True, needs="${"),
    _r("SQL_INJECTION_TEMPLATE_STRING", "critical", "sql_injection", r"(?i)(?<![\w.])(?:const|let|var)\s+\w*(?:sql|query)\w*\s*=\s*`[^`]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^`]*\$\{", "SQL template with values", absent=r"\bsql`|Prisma\.sql", needs="${"),
    _r("SQL_INJECTION_FSTRING", "critical", "sql_injection", r"(?i)\bf['\"][^'\"]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^'\"]*\{", "SQL in an f-string", "Use parameters", fixable=True, needs="{"),
    _r("SQL_INJECTION_FORMAT", "critical", "sql_injection", r"(?i)['\"][^'\"]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^'\"]*['\"]\s*(?:\.format\s*\(|%\s*[\w(])", "SQL by string formatting", "Use parameters", fixable=True, needs=(".format", "%")),
    _r("ORM_RAW_QUERY_UNSAFE", "high", "sql_injection", r"\$(?:queryRawUnsafe|executeRawUnsafe)\s*\(", "Raw query without parameters", needs="RawUnsafe"),
    _r("DRIZZLE_RAW_TEMPLATE", "high", "sql_injection", r"\bsql\.raw\s*\(\s*`[^`]*\$\{", "Raw SQL template", needs="sql.raw"),
    _r("MONGOOSE_WHERE_INJECTION", "critical", "nosql_injection", r"\$where\s*['\"]?\s*:\s*(?:`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+|" + _USER + ")", "A condition is run as code", needs="$where"),
    _r("MONGO_SET_FROM_BODY", "high", "nosql_injection", r"\$set\s*['\"]?\s*:\s*req\.body", "A document is updated from the request", needs="$set"),
    _r("XSS_INNERHTML", "high", "xss", r"\.innerHTML\s*\+?=\s*(?!['\"`]['\"`]|['\"][^'\"$+]*['\"]\s*;?\s*$)", "Markup is assigned", "Use textContent", fixable=True, needs="innerHTML", absent=r"DOMPurify|sanitize|escapeHtml"),
    _r("XSS_DOCUMENT_WRITE", "high", "xss", r"\bdocument\.write(?:ln)?\s*\(", "Markup is written", needs="document.write"),
    _r("XSS_DANGEROUSLY_SET_INNERHTML", "high", "xss", r"dangerouslySetInnerHTML\s*=\s*\{\{", "Markup is set", "Sanitise it", fixable=True, needs="dangerouslySetInnerHTML", absent=r"DOMPurify|sanitize"),
    _r("XSS_EVAL", "critical", "code_injection", r"(?<![\w.])eval\s*\(\s*(?!['\"][^'\"]*['\"]\s*\))", "Code from data", needs="eval"),
    _r("XSS_UNESCAPED_TEMPLATE", "high", "xss", r"<%-\s*\w|\{\{\{\s*\w|\|\s*safe\s*\}\}", "Output without escapes", needs=("<%-", "{{{", "| safe", "|safe")),
    _r("CMD_INJECTION_EXEC", "critical", "command_injection", r"(?<![\w.])(?:child_process\.|cp\.)?(?:exec|execSync)\s*\(\s*(?:`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+)", "A shell command from values", needs="exec"),
    _r("CMD_INJECTION_SPAWN_SHELL", "high", "command_injection", r"\bspawn(?:Sync)?\s*\([^)]*shell\s*:\s*true", "A shell runs the command", needs="spawn"),
    _r("CMD_INJECTION_OS_SYSTEM", "critical", "command_injection", r"\bos\.(?:system|popen)\s*\(\s*(?:f['\"]|['\"][^'\"]*['\"]\s*[+%]|\w+\s*[+)])", "A shell command from values", needs="os."),
    _r("CMD_INJECTION_SUBPROCESS_SHELL", "critical", "command_injection", r"\bsubprocess\.\w+\s*\([^)]*shell\s*=\s*True", "A shell runs the command", needs="subprocess"),
    _r("PATH_TRAVERSAL", "high", "path_traversal", r"\b(?:readFile(?:Sync)?|createReadStream|sendFile|open)\s*\([^)]*" + _USER, "A path from the request", needs=("readFile", "createReadStream", "sendFile", "open")),
    _r("SSRF", "high", "ssrf", r"\b(?:fetch|axios(?:\.\w+)?|requests\.\w+|http\.get|got)\s*\(\s*(?:`[^`]*\$\{\s*)?" + _USER, "An address from the request", needs=("fetch", "axios", "requests.", "http.get", "got")),
    _r("REDIRECT_UNVALIDATED", "medium", "open_redirect", r"\bredirect\s*\(\s*" + _USER, "A redirect from the request", needs="redirect"),
    _r("HOST_HEADER_INJECTION", "medium", "header_injection", r"(?:`https?://\$\{\s*|https?://['\"]\s*\+\s*)req\.(?:headers\.host|get\(['\"]host['\"]\)|hostname)", "An address from the host header", needs="req."),
    _r("HEADER_INJECTION", "medium", "header_injection", r"\.(?:setHeader|writeHead|header|set)\s*\([^)]*" + _USER, "A header from the request", needs=("eader", "writeHead", ".set")),
    _r("EMAIL_HEADER_INJECTION", "medium", "header_injection", r"\b(?:to|cc|bcc|from|subject|replyTo)\s*:\s*(?:`[^`]*\$\{\s*)?req\.(?:body|query)", "A mail header from the request", needs="req."),
    _r("LDAP_INJECTION", "high", "ldap_injection", r"\(\s*(?:uid|cn|sAMAccountName)=(?:\$\{|['\"`]\s*\+)", "A directory filter from values", needs=("uid=", "cn=", "sAMAccountName=")),
    _r("XXE_PARSER_UNSAFE", "high", "xxe", r"noent\s*:\s*true|resolve_entities\s*=\s*True|XMLParser\s*\([^)]*load_dtd\s*=\s*True", "External entities are read", needs=("noent", "resolve_entities", "load_dtd")),
    _r("SSTI_RENDER_USER_INPUT", "critical", "template_injection", r"\b(?:render_template_string|renderString|compile|ejs\.render|pug\.render|nunjucks\.renderString)\s*\(\s*" + _USER, "A template from the request", needs=("render", "compile")),
    _r("UNSAFE_DESERIALIZATION_PICKLE", "critical", "deserialization", r"\b(?:pickle|cPickle|dill)\.loads?\s*\(", "Objects from bytes", needs=("ickle", "dill")),
    _r("UNSAFE_DESERIALIZATION_YAML", "high", "deserialization", r"\byaml\.load\s*\((?![^)]*(?:SafeLoader|CSafeLoader))", "Objects from YAML", needs="yaml.load"),
    _r("DYNAMIC_REQUIRE", "medium", "supply_chain", r"\brequire\s*\(\s*(?:`[^`]*\$\{|[a-zA-Z_]\w*\s*[+)])", "A module by a computed name", needs="require"),
    _r("SUPPLY_CHAIN_POSTINSTALL", "high", "supply_chain", r"\"(?:pre|post)install\"\s*:\s*\"[^\"]*(?:curl|wget|node\s+-e|sh\b)", "An install script fetches or runs code", needs="install"),
    _r("CRYPTO_MD5", "medium", "weak_crypto", r"createHash\s*\(\s*['\"]md5['\"]|\bhashlib\.md5\s*\(", "MD5 is broken", needs="md5"),
    _r("CRYPTO_SHA1", "medium", "weak_crypto", r"createHash\s*\(\s*['\"]sha1['\"]|\bhashlib\.sha1\s*\(", "SHA-1 is broken", needs="sha1"),
    _r("HMAC_WITH_SHA1", "medium", "weak_crypto", r"createHmac\s*\(\s*['\"]sha1['\"]", "HMAC over SHA-1", needs="createHmac"),
    _r("CRYPTO_WEAK_CIPHER", "high", "weak_crypto", r"createCipher(?:iv)?\s*\(\s*['\"](?:des|des-ede3|rc4|bf|aes-\d+-ecb)[^'\"]*['\"]|\bDES\.new\(|MODE_ECB", "A weak cipher", needs=("createCipher", "DES.new", "MODE_ECB")),
    _r("CRYPTO_NO_AEAD", "medium", "weak_crypto", r"create(?:C|Dec)ipheriv\s*\(\s*['\"]aes-\d+-(?:cbc|ctr)['\"]", "A cipher without authentication", needs="ipheriv"),
    _r("CRYPTO_MATH_RANDOM", "medium", "weak_random", r"(?i)(?:token|secret|password|key|nonce|salt|otp|session)\w*\s*[:=][^;]*Math\.random\s*\(", "Secrets from a weak generator", needs="Math.random"),
    _r("CRYPTO_DSA_USAGE", "medium", "weak_crypto", r"generateKeyPair(?:Sync)?\s*\(\s*['\"]dsa['\"]", "DSA keys", needs="generateKeyPair"),
    _r("RSA_KEY_TOO_SMALL", "high", "weak_crypto", r"modulusLength\s*:\s*(?:512|768|1024)\b|RSA\.generate\s*\(\s*(?:512|768|1024)\b", "A short RSA key", needs=("modulusLength", "RSA.generate")),
    _r("ECDSA_P192_CURVE", "medium", "weak_crypto", r"namedCurve\s*:\s*['\"](?:P-192|secp192\w*|prime192v1)['\"]", "A short curve", needs="namedCurve"),
    _r("PKCS1_V15_PADDING", "medium", "weak_crypto", r"RSA_PKCS1_PADDING\b|PKCS1v15\s*\(", "Padding that leaks", needs=("RSA_PKCS1_PADDING", "PKCS1v15")),
    _r("WEAK_PASSWORD_HASH", "high", "weak_crypto", r"(?i)createHash\s*\(\s*['\"](?:md5|sha1|sha256)['\"]\s*\)\.update\s*\(\s*\w*pass", "A fast hash over passwords", needs="createHash"),
    _r("HARDCODED_ENCRYPTION_KEY_V2", "critical", "hardcoded_secret", r"(?i)(?:encryption|cipher|aes)_?key\s*[:=]\s*(?:Buffer\.from\s*\(\s*)?['\"][A-Za-z0-9+/=]{16,}['\"]", "A key is written into the code", absent=r"process\.env|os\.environ", needs=("key", "Key", "KEY")),
    _r("TLS_CERT_VALIDATION_BYPASS", "critical", "tls", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0|verify\s*=\s*False|_create_unverified_context", "Certificates aren't checked", needs=("rejectUnauthorized", "NODE_TLS_REJECT_UNAUTHORIZED", "verify", "_create_unverified_context")),
    _r("JWT_ALG_NONE", "critical", "auth", r"algorithms?\s*['\"]?\s*:\s*\[?\s*['\"]none['\"]", "Unsigned tokens are taken", needs="none"),
    _r("JWT_DECODE_WITHOUT_VERIFY", "high", "auth", r"\bjwt\.decode\s*\((?![^)]*verify\s*=\s*True)", "A token is read unchecked", needs="jwt.decode"),
    _r("AUTH_TOKEN_IN_URL", "high", "auth", r"[?&](?:token|access_token|auth|api_key|jwt)=(?:\$\{|['\"]\s*\+)|`[^`]*/\$\{\s*\w*[tT]oken\s*\}", "A token in an address", needs=("oken", "auth", "api_key", "jwt")),
    _r("TIMING_UNSAFE_RESET_TOKEN", "medium", "auth", r"(?i)\b\w*(?:token|secret|signature|hmac)\w*\s*={2,3}\s*(?:req\.|request\.|params\.|body\.|stored|expected|saved)", "Secrets are compared in varying time", needs="=="),
    _r("COOKIE_NO_HTTPONLY", "medium", "cookie", r"httpOnly\s*:\s*false|httponly\s*=\s*False", "Scripts can read the cookie", needs=("httpOnly", "httponly")),
    _r("COOKIE_NO_SECURE", "medium", "cookie", r"(?:cookie|session)[^;\n]*secure\s*:\s*false", "The cookie goes unencrypted", needs="secure"),
    _r("CORS_WILDCARD", "medium", "cors", r"origin\s*:\s*['\"]\*['\"]|Access-Control-Allow-Origin['\"]\s*,\s*['\"]\*['\"]|CORS_ORIGIN_ALLOW_ALL\s*=\s*True", "Every origin is allowed", needs=("origin", "Access-Control-Allow-Origin", "CORS_ORIGIN_ALLOW_ALL")),
    _r("S3_PUBLIC_ACL", "high", "cloud", r"ACL['\"]?\s*[:=]\s*['\"]public-read", "A public bucket", needs="public-read"),
    _r("DEBUG_ENABLED", "medium", "config", r"\bdebug\s*=\s*True\b|app\.run\([^)]*debug\s*=\s*True", "Debug mode", needs="True"),
    _r("NEXT_PUBLIC_SECRET", "high", "config", r"NEXT_PUBLIC_\w*(?:SECRET|PRIVATE|PASSWORD|SERVICE_ROLE)\w*", "A secret that browsers get", needs="NEXT_PUBLIC_"),
    _r("GRAPHQL_INTROSPECTION", "low", "graphql", r"introspection\s*:\s*true", "The schema is open", needs="introspection"),
    _r("TYPEORM_SYNCHRONIZE_PRODUCTION", "medium", "config", r"synchronize\s*:\s*true", "The schema follows the code", needs="synchronize"),
    _r("MONGOOSE_NO_STRICT", "low", "config", r"new\s+(?:mongoose\.)?Schema\s*\(.*strict\s*:\s*false", "Unknown fields are stored", needs="strict"),
    _r("EXPRESS_STATIC_FROM_ROOT", "high", "config", r"express\.static\s*\(\s*(?:['\"](?:\.|/|\./)['\"]|__dirname|process\.cwd\(\))\s*\)", "The whole project is served", needs="express.static"),
    _r("BODYPARSER_MISSING_LIMIT", "low", "config", r"(?:bodyParser|express)\.(?:json|urlencoded)\s*\(\s*(?:\)|\{(?![^}]*limit))", "No limit on a request's size", needs=("bodyParser", "express.")),
    _r("TRUST_USER_AGENT_HEADER", "low", "auth", r"if\s*\(\s*req\.headers\[['\"]user-agent['\"]\]|if\s*\([^)]*user-agent['\"]\]\s*(?:===?|\.includes)", "Trust in a header", needs="user-agent"),
    _r("TRACE_METHOD_ENABLED", "low", "config", r"\b(?:app|router)\.trace\s*\(|methods\s*:\s*\[[^\]]*['\"]TRACE['\"]", "TRACE is answered", needs=(".trace", "TRACE")),
    _r("HTTP_METHOD_OVERRIDE", "low", "config", r"\bmethodOverride\s*\(", "The method comes from the request", needs="methodOverride"),
    _r("TRANSFER_ENCODING_SMUGGLING", "medium", "header_injection", r"(?i)insecureHTTPParser\s*:\s*true|setHeader\s*\(\s*['\"]transfer-encoding['\"]", "Lenient parsing of requests", needs=("HTTPParser", "etHeader")),
    _r("PROTOTYPE_POLLUTION", "high", "prototype_pollution", r"Object\.assign\s*\(\s*\w+\s*,\s*req\.(?:body|query)|_\.merge\s*\([^)]*req\.(?:body|query)|\[['\"]__proto__['\"]\]", "Keys from the request", needs=("Object.assign", "_.merge", "__proto__")),
    _r("MASS_ASSIGNMENT", "medium", "mass_assignment", r"\.(?:create|update|insert|save)\s*\(\s*(?:\{\s*(?:data\s*:\s*)?)?(?:\.\.\.)?req\.body", "All fields from the request", needs="req.body"),
    _r("PII_IN_DEBUG_LOG", "medium", "privacy", r"(?i)console\.(?:log|debug|info)\s*\([^)]*\b(?:ssn|password|email|creditCard|card_number|dateOfBirth)\b", "Personal data in a log", needs="console."),
    _r("KEY_MATERIAL_IN_LOG", "high", "privacy", r"(?i)(?:console\.\w+|logger\.\w+|print)\s*\([^)]*\b\w*(?:privateKey|secretKey|private_key|secret_key|apiKey|api_key)\b", "Keys in a log", needs=("console", "logger", "print")),
    _r("DB_CREDENTIALS_IN_LOG", "high", "privacy", r"(?i)(?:console\.\w+|logger\.\w+|print)\s*\([^)]*(?:DATABASE_URL|DB_PASSWORD|connectionString)", "Credentials in a log", needs=("console", "logger", "print")),
    _r("SENSITIVE_DATA_IN_URL", "medium", "privacy", r"(?i)[?&](?:ssn|password|card|cvv|dob)=(?:\$\{|['\"]\s*\+)", "Personal data in an address", needs="="),
    _r("DATA_ERROR_DETAILS_LEAK", "low", "privacy", r"\.(?:json|send)\s*\([^)]*\b(?:err|error|e)\.(?:stack|message)\b", "Errors are shown in full", needs=(".stack", ".message")),
    _r("PROMPT_INJECTION_CONCAT", "high", "prompt_injection", r"(?i)\b(?:prompt|systemPrompt|system_prompt|instructions)\s*(?:=|\+=|:)\s*(?:['\"`][^'\"`]*['\"`]\s*\+\s*\w*(?:user|input|req|message|query)|`[^`]*\$\{\s*(?:req|ctx|user|input))", "A prompt from user text", needs=("rompt", "nstructions")),
    _r("PROMPT_INJECTION_TEMPLATE", "high", "prompt_injection", r"(?i)(?:\b(?:prompt|systemPrompt|system_prompt|instructions)\s*(?:=|:)\s*`[^`]*|`[^`]*\b(?:You are (?:a|an)|Act as|Summari[sz]e)\b[^`]*)\$\{\s*\w*(?:user|input|req|message|query)", "A prompt from user text", needs="${"),
    _r("PROMPT_INJECTION_SYSTEM_ROLE_USER_INPUT", "high", "prompt_injection", r"role\s*:\s*['\"]system['\"]\s*,\s*content\s*:\s*(?:`[^`]*\$\{|" + _USER + ")", "User text in the system's role", needs="system"),
    _r("PROMPT_INJECTION_PYTHON_FSTRING", "high", "prompt_injection", r"(?i)\b(?:prompt|system_prompt)\s*=\s*f['\"]{1,3}[^'\"]*\{\s*\w*(?:user|input|request|message|query)", "A prompt from user text", needs="rompt"),
    _r("AI_OUTPUT_EVAL", "critical", "code_injection", r"(?i)\b(?:eval|exec|new Function)\s*\(\s*\w*(?:completion|response|llm|ai)\w*", "A model's output is run", needs=("eval", "exec", "Function")),
    _r("AI_OUTPUT_HTML", "high", "xss", r"(?i)\.innerHTML\s*=\s*\w*(?:completion|response|llm|ai)\w*", "A model's output as markup", needs="innerHTML"),
    _r("WEBSOCKET_INSECURE", "low", "tls", r"new\s+WebSocket\s*\(\s*['\"`]ws://(?!localhost|127\.)", "An unencrypted socket", needs="WebSocket"),
    _r("REGEX_DOS", "low", "regex", r"new\s+RegExp\s*\(\s*" + _USER, "A pattern from the request", needs="RegExp"),
    _r("RACE_CONDITION_TOCTOU", "low", "race", r"\bif\s*\(\s*(?:fs\.)?existsSync\s*\([^)]*\)\s*\)\s*\{?\s*(?:return\s+)?(?:fs\.)?(?:readFile|writeFile|unlink)", "A check before use", needs="existsSync"),
)

# fixed values: patterns and descriptions of obfuscated code
OBFUSCATED = (
    Rule("OBFUSCATED_EVAL", r"eval\s*\(\s*(?:atob|Buffer\.from|decodeURIComponent)\s*\(", "high", "malicious", "eval() with encoded content", needs="eval"),
    Rule("OBFUSCATED_HEX", r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){10,}", "high", "malicious", "long hex-encoded string", needs="\\x"),
    Rule("OBFUSCATED_CHARCODES", r"String\.fromCharCode\s*\(\s*(?:\d+\s*,\s*){5,}", "high", "malicious", "String.fromCharCode with many character codes", needs="fromCharCode"),
    Rule("OBFUSCATED_PROPERTY", r"\['\\x", "high", "malicious", "hex-encoded property access", needs="['\\x"),
    Rule("OBFUSCATED_FUNCTION", r"Function\s*\(\s*['\"]return\s", "high", "malicious", "Function constructor with return", needs="Function"),
    Rule("INLINE_SCRIPT", r"<script>", "high", "script", "inline script", needs="<script>"),
)

RULES = SECRETS + VULNERABILITIES + rulebook_web.RULES + rulebook_python.RULES
#: Rules that a framework's own defaults make needless: (id, framework).
FRAMEWORK_GATES = (("BODYPARSER_MISSING_LIMIT", "next"), ("COOKIE_NO_SECURE", "next"), ("EXPRESS_STATIC_FROM_ROOT", "next"))
