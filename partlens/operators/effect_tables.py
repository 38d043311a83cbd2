"""Imports and calls that mean an effect, per language.

These decide which effects are detected and must keep these values; ``None`` marks an
entry that is known and has no effect.
"""

IMPORT_EFFECTS: dict[str, dict[str, str | None]] = {
    "python": {
        "requests": "network", "httpx": "network", "urllib.request": "network", "urllib3": "network", "socket": "network",
        "aiohttp": "network", "ssl": "network", "pathlib": "filesystem", "shutil": "filesystem", "glob": "filesystem",
        "tempfile": "filesystem", "subprocess": "subprocess", "multiprocessing": "subprocess", "sqlite3": "database",
        "psycopg2": "database", "sqlalchemy": "database", "pymongo": "database", "redis": "database", "random": "random",
        "secrets": "random", "serial": "hardware", "pymavlink": "hardware", "dronekit": "hardware",
    },
    "javascript": {
        "http": "network", "https": "network", "net": "network", "axios": "network", "node-fetch": "network", "ws": "network",
        "fs": "filesystem", "fs/promises": "filesystem", "path": None, "child_process": "subprocess",
        "worker_threads": "subprocess", "pg": "database", "mysql": "database", "mysql2": "database", "mongoose": "database",
        "mongodb": "database", "sqlite3": "database", "crypto": "random", "serialport": "hardware",
    },
    "go": {
        "net/http": "network", "net": "network", "crypto/tls": "network", "os/exec": "subprocess", "database/sql": "database",
        "math/rand": "random", "crypto/rand": "random", "io/ioutil": "filesystem", "path/filepath": None, "os": "filesystem",
        "time": "clock",
    },
    "rust": {
        "reqwest": "network", "hyper": "network", "tokio::net": "network", "std::net": "network", "std::fs": "filesystem",
        "tokio::fs": "filesystem", "std::process": "subprocess", "std::env": "env", "std::time": "clock", "rand": "random",
        "sqlx": "database", "diesel": "database", "rusqlite": "database", "serialport": "hardware",
    },
    "java": {
        "java.net": "network", "okhttp3": "network", "org.apache.http": "network", "java.io": "filesystem",
        "java.nio.file": "filesystem", "java.sql": "database", "javax.sql": "database", "java.util.Random": "random",
        "java.security.SecureRandom": "random", "java.time": "clock",
    },
    "c": {
        "sys/socket.h": "network", "netinet": "network", "curl": "network", "stdio.h": None, "fcntl.h": "filesystem",
        "unistd.h": None, "termios.h": "hardware",
    },
    "cpp": {
        "sys/socket.h": "network", "netinet": "network", "curl": "network", "fstream": "filesystem",
        "filesystem": "filesystem", "thread": None, "chrono": "clock", "random": "random", "termios.h": "hardware",
        "boost/asio": "network", "mavsdk": "hardware",
    },
}
IMPORT_EFFECTS["typescript"] = IMPORT_EFFECTS["javascript"]

HARMLESS_IMPORTS: dict[str, tuple[str, ...]] = {
    "python": (
        "urllib.parse", "urllib.error", "urllib3.exceptions", "urllib3.fields", "urllib3.filepost", "urllib3.util",
        "urllib3.response", "requests.exceptions", "requests.structures", "requests.compat", "io.StringIO", "io.BytesIO",
        "socket.error", "socket.timeout",
    ),
    "javascript": ("http-errors", "path", "url"),
    "typescript": ("http-errors", "path", "url"),
    "go": ("net/url", "net/http/httptest", "net/textproto", "net/mail", "os/signal", "os/user", "time"),
    "rust": ("std::net::IpAddr", "std::net::SocketAddr", "hyper::header", "reqwest::header", "std::time::Duration"),
    "java": (
        "java.net.URI", "java.net.URL", "java.net.URLEncoder", "java.net.URLDecoder", "java.io.IOException",
        "java.io.Serializable", "java.io.InputStream", "java.io.OutputStream", "java.io.Reader", "java.io.Writer",
        "java.io.StringReader", "java.io.StringWriter", "java.io.ByteArrayInputStream", "java.io.ByteArrayOutputStream",
        "java.io.UncheckedIOException", "java.time.Duration",
    ),
    "c": (),
    "cpp": ("chrono",),
}

CALL_EFFECTS: dict[str, dict[str, str | None]] = {
    "python": {
        "open": "filesystem", "os.environ": "env", "os.getenv": "env", "os.system": "subprocess", "os.popen": "subprocess",
        "time.time": "clock", "time.sleep": "clock", "datetime.now": "clock", "datetime.utcnow": "clock",
        "os.remove": "filesystem", "os.listdir": "filesystem", "os.makedirs": "filesystem",
    },
    "javascript": {
        "fetch": "network", "process.env": "env", "Date.now": "clock", "Math.random": "random", "require": None,
        "setTimeout": "clock", "setInterval": "clock",
    },
    "go": {
        "os.Getenv": "env", "os.Environ": "env", "time.Now": "clock", "time.Sleep": "clock", "os.Open": "filesystem",
        "os.Create": "filesystem", "os.ReadFile": "filesystem", "os.WriteFile": "filesystem", "os.Remove": "filesystem",
        "os.Stat": "filesystem", "ioutil.ReadFile": "filesystem", "exec.Command": "subprocess", "rand.Intn": "random",
    },
    "rust": {
        "std::env::var": "env", "env::var": "env", "Instant::now": "clock", "SystemTime::now": "clock",
        "Command::new": "subprocess", "File::open": "filesystem", "File::create": "filesystem", "fs::read": "filesystem",
        "fs::write": "filesystem", "fs::read_to_string": "filesystem", "TcpStream::connect": "network",
    },
    "java": {
        "System.getenv": "env", "System.currentTimeMillis": "clock", "Instant.now": "clock", "System.nanoTime": "clock",
        "Runtime.exec": "subprocess", "ProcessBuilder": "subprocess", "Files.read": "filesystem",
        "Files.write": "filesystem", "new File": "filesystem", "Math.random": "random",
    },
    "c": {
        "fopen": "filesystem", "open": "filesystem", "read": None, "write": None, "system": "subprocess",
        "popen": "subprocess", "fork": "subprocess", "exec": "subprocess", "getenv": "env", "time": "clock",
        "clock_gettime": "clock", "rand": "random", "socket": "network", "connect": "network", "ioctl": "hardware",
    },
}
CALL_EFFECTS["typescript"] = CALL_EFFECTS["javascript"]
CALL_EFFECTS["cpp"] = {
    **CALL_EFFECTS["c"], "std::ifstream": "filesystem", "std::ofstream": "filesystem", "std::getenv": "env",
}
