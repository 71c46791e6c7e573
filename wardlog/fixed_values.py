"""They must equal the values users rely on today, or results differ."""

# --- severities, lowest first; the position is the rank -----------------------
SEVERITIES = ["info", "low", "medium", "high", "critical"]

# --- event types ---------------------------------------------------------------
FAILED_LOGIN_TYPES = ["login_failed", "unauthorized", "invalid_user"]
SUCCESS_LOGIN_TYPES = ["login_success", "session_opened"]
STREAK_FAILURE_TYPES = ["login_failed", "invalid_user"]
PRIVILEGED_USE_TYPES = ["login_success", "session_opened", "sudo_command"]
WAF_TYPES = ["waf_block", "waf_allow", "waf_count"]
TIMELINE_TYPES = [
    "login_failed", "login_success", "invalid_user", "session_opened", "sudo_command",
    "unauthorized", "forbidden", "server_error", "firewall_block", "firewall_allow",
]
TIMELINE_SEVERITY = {
    "login_failed": "low", "invalid_user": "low",
    "unauthorized": "medium", "forbidden": "medium", "firewall_block": "medium",
    "server_error": "high",
}
NOTABLE_TYPES = [
    "login_failed", "login_success", "unauthorized", "forbidden",
    "server_error", "sudo_command", "firewall_block",
]
PRIVILEGED_ACCOUNTS = ["root", "admin", "administrator", "sysadmin", "superuser"]

# --- formats -------------------------------------------------------------------
WAF, AUTH, ACCESS, ERROR, JSON, FIREWALL = (
    "AwsWafCsv", "Auth", "NginxAccess", "NginxError", "JSON", "Firewall",
)
FORMAT_ORDER = [WAF, AUTH, ACCESS, ERROR, JSON, FIREWALL]
FORMAT_HINTS = {
    "auth": AUTH, "syslog": AUTH, "secure": AUTH,
    "nginx": ACCESS, "apache": ACCESS, "access": ACCESS, "nginx_error": ERROR,
    "json": JSON, "jsonl": JSON,
    "firewall": FIREWALL, "iptables": FIREWALL, "ufw": FIREWALL,
    "aws_waf": WAF, "waf": WAF, "csv": WAF,
}
LOG_EXTENSIONS = ["log", "txt", "json", "jsonl", "csv", "gz"]
AUTH_KEYWORDS = ["sshd", "sudo", "pam_unix", "Failed password", "Accepted password", "session opened"]
FIREWALL_KEYWORDS = [
    "UFW", "BLOCK", "ALLOW", "DENY", "DROP", "ACCEPT", "REJECT", "iptables",
    "SRC=", "DST=", "PROTO=", "DPT=", "SPT=", "rule", "pass", "block",
]

# --- line patterns; (?d): '.' stops at newline only, (?U): Unicode classes --------
SYSLOG_TIME = r"(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
AUTH_LINE = rf"(?dU)^{SYSLOG_TIME}\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?\s*:\s+(.*)$"
FAILED_PASSWORD = r"(?dU)Failed password for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)"
ACCEPTED_LOGIN = r"(?dU)Accepted (?:password|publickey) for (\S+) from ([\d.]+) port (\d+)"
INVALID_USER = r"(?dU)Invalid user (\S+) from ([\d.]+)"
SESSION_OPENED = r"(?dU)pam_unix\(\S+\):?\s+session opened for user (\S+)"
SESSION_CLOSED = r"(?dU)pam_unix\(\S+\):?\s+session closed for user (\S+)"
SUDO_COMMAND = r"(?dU)(\S+)\s*:\s*.*COMMAND=(.*)"
CONNECTION_CLOSED = r"(?dU)Connection closed by (?:authenticating user )?(\S+)?\s*([\d.]+)"
ACCESS_LINE = (
    r"(?dU)^([\d.]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"
    r'"(\w+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\d+|-)\s*'
    r'(?:"([^"]*)")?\s*(?:"([^"]*)")?.*$'
)
ERROR_LINE = (
    r"(?dU)^(\d{4})/(\d{2})/(\d{2})\s+(\d{2}):(\d{2}):(\d{2})\s+"
    r"\[(\w+)\]\s+(\d+)#\d+:\s+(?:\*\d+\s+)?(.*)$"
)
ERROR_CLIENT = r"(?dU)client:\s*([\d.]+)"
PF_LINE = (
    rf"(?dU)^.*?{SYSLOG_TIME}\s+.*rule\s+\d+.*\s+(pass|block)\s+(in|out)\s+on\s+(\S+):\s+"
    r"([\d.]+)\.(\d+)\s*>\s*([\d.]+)\.(\d+).*$"
)
KERNEL_LINE = (
    rf"(?dU)^{SYSLOG_TIME}\s+(\S+)\s+kernel:\s+(?:\[\s*[\d.]+\]\s*)?(?:\[([^\]]+)\]\s*)?(.*)$"
)
KEY_VALUE = r"(?U)(\w+)=(\S+)"

# --- request classes -------------------------------------------------------------
LOGIN_PATHS = ["/login", "/auth", "/signin"]
ADMIN_PATHS = ["/admin", "/dashboard", "/manage"]
WRITE_METHODS = ["POST", "PUT", "DELETE", "PATCH"]

# --- JSON key aliases ------------------------------------------------------------
JSON_TIME = ["timestamp", "time", "@timestamp", "datetime", "date", "created_at", "ts", "log_time"]
JSON_IP = ["ip", "source_ip", "src_ip", "client_ip", "remote_addr", "ipAddress", "sourceAddress"]
JSON_USER = ["user", "username", "user_name", "userId", "user_id", "account", "actor"]
JSON_ENDPOINT = ["endpoint", "path", "url", "uri", "request_uri", "route"]
JSON_METHOD = ["method", "http_method", "request_method", "verb"]
JSON_STATUS = ["status", "status_code", "statusCode", "http_status", "response_code"]
JSON_MESSAGE = ["message", "msg", "log", "description", "text", "detail"]
JSON_EVENT = ["event", "event_type", "eventType", "action", "type", "category"]
JSON_LEVEL = ["level", "severity", "log_level", "loglevel", "priority"]
JSON_SIZE = ["size", "bytes", "content_length", "response_size"]

# --- WAF column aliases ------------------------------------------------------------
WAF_COLUMNS = {
    "timestamp": ["timestamp", "@timestamp", "time"],
    "action": ["action"],
    "uri": ["uri", "path"],
    "method": ["httpmethod", "method"],
    "client_ip": ["clientip", "client_ip", "sourceip", "ip"],
    "host": ["host", "hostname"],
    "country": ["country"],
    "rule": ["terminatingruleid", "rule", "terminating_rule_id"],
}
WAF_EVENTS = {"BLOCK": "waf_block", "ALLOW": "waf_allow", "COUNT": "waf_count"}

# --- attack signatures: category -> [(pattern, ignores case)] --------------------------
ATTACK_SIGNATURES = {
    "SQL Injection": [
        (r"(?:union\s+select|select\s+.*from|drop\s+table|insert\s+into|update\s+.*set)", True),
        (r"(?:or\s+1\s*=\s*1|and\s+1\s*=\s*1|'\s*or\s*'|'\s*--)", True),
        (r"(?:sleep\s*\(|benchmark\s*\(|waitfor\s+delay)", True),
        (r"(?:0x[0-9a-f]+|char\s*\(|concat\s*\()", True),
    ],
    "Cross-Site Scripting (XSS)": [
        (r"<\s*script[^>]*>", True),
        (r"(?:javascript|vbscript)\s*:", True),
        (r"(?:on(?:error|load|click|mouseover|focus|blur)\s*=)", True),
        (r"(?:alert|confirm|prompt)\s*\(", True),
        (r"document\.(?:cookie|write|location)", True),
    ],
    "Path Traversal": [
        (r"(?:\.\./|\.\.\\){2,}", False),
        (r"(?:/etc/passwd|/etc/shadow|/proc/self)", True),
        (r"(?:c:\\windows|c:\\boot\.ini)", True),
    ],
    "Command Injection": [
        (r"(?:;\s*(?:ls|cat|id|whoami|uname|curl|wget|nc|ncat|bash|sh|python|perl|ruby))", True),
        (r"(?:\|\s*(?:ls|cat|id|whoami|uname))", True),
        (r"(?:`[^`]+`|\$\([^)]+\))", False),
    ],
    "Vulnerability Scanning": [
        (r"(?:nikto|nmap|sqlmap|burp|dirbuster|gobuster|wfuzz|hydra|nessus)", True),
        (r"(?:wp-admin|wp-login|wp-content|xmlrpc\.php)", True),
        (r"(?:\.env|\.git|\.svn|\.htaccess|web\.config|\.DS_Store)", True),
        (r"(?:phpmyadmin|adminer|phpinfo)", True),
    ],
}
SCANNING = "Vulnerability Scanning"
# category -> lower-case texts, one of which every match of its signatures holds
ATTACK_MARKS = {
    "SQL Injection": [
        "union", "select", "drop", "insert", "update", "=", "'", "sleep", "benchmark", "waitfor", "0x", "char", "concat",
    ],
    "Cross-Site Scripting (XSS)": [
        "<", "script", "=", "alert", "confirm", "prompt", "document.",
    ],
    "Path Traversal": ["../", "..\\", "/etc/", "/proc/", "c:\\"],
    "Command Injection": [";", "|", "`", "$("],
    "Vulnerability Scanning": [
        "nikto", "nmap", "sqlmap", "burp", "dirbuster", "gobuster", "wfuzz", "hydra", "nessus", "wp-", "xmlrpc.php",
        ".env", ".git", ".svn", ".htaccess", "web.config", ".ds_store", "phpmyadmin", "adminer", "phpinfo",
    ],
}
