"""Two small scenarios made from parameters; what the tests expect of them follows from these numbers."""

SPRAYER, SPRAYED, SPRAY_GAP = "198.51.100.71", 24, 7
PATIENT, PATIENT_TRIES, PATIENT_GAP = "198.51.100.140", 6, 400
NIGHT_LOGIN = "198.51.100.9"
REFUSED, REFUSALS = "203.0.113.40", 12
SCANNER, ATTACKER = "203.0.113.90", "203.0.113.91"
VISITS = 20


def _clock(hour, second):
    return f"{hour + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def auth_scenario(breached=True):
    """36 lines: one password tried on many names, a patient guesser who gets in, a login at night.

    The sprayer gets in with the last line, which ``breached=False`` leaves out.
    """
    log = []

    def add(clock, service, message):
        log.append(f"Feb  9 {clock} gate7 {service}: {message}")

    for i in range(SPRAYED):
        add(_clock(13, 300 + i * SPRAY_GAP), "sshd[410]", f"Failed password for invalid user svc{i:02d} from {SPRAYER} port {51000 + i} ssh2")
    for i in range(PATIENT_TRIES):
        add(_clock(14, i * PATIENT_GAP), "sshd[502]", f"Failed password for mara from {PATIENT} port 40100 ssh2")
    add("14:50:00", "sshd[502]", f"Accepted password for mara from {PATIENT} port 40100 ssh2")
    add("14:50:00", "sshd[502]", "pam_unix(sshd:session): session opened for user mara")
    add("14:51:00", "sudo", "mara : TTY=pts/3 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/less /etc/passwd")
    add("23:30:05", "sshd[611]", f"Accepted publickey for root from {NIGHT_LOGIN} port 40200 ssh2")
    add("23:31:00", "sshd[611]", "pam_unix(sshd:session): session closed for user root")
    if breached:
        add("13:09:00", "sshd[410]", f"Accepted password for svc03 from {SPRAYER} port 52000 ssh2")
    return "\n".join(log)


def access_scenario():
    """38 lines: visits to a shop, refused sign-ins, a scanner, and requests holding attacks."""
    log = []

    def add(ip, clock, request, status, user="-"):
        log.append(f'{ip} - {user} [09/Feb/2026:{clock} +0000] "{request} HTTP/1.1" {status} {100 + len(log)} "-" "shop/2"')

    for i in range(REFUSALS):
        add(REFUSED, _clock(11, i * 4), "POST /session", 401, "kim")
    for i, path in enumerate(["/.env", "/wp-login.php", "/.env"]):
        add(SCANNER, _clock(12, i), f"GET {path}", 404)
    for i, path in enumerate(["/find?q=<script>1</script>", "/dl?name=/etc/passwd", "/dl?name=/etc/passwd"]):
        add(ATTACKER, _clock(12, 60 + i), f"GET {path}", 200)
    for i in range(VISITS):
        add(f"192.0.2.{i % 5 + 1}", _clock(15, i * 90), f"GET /catalog/{i}", 200)
    return "\n".join(log)
