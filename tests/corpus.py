"""Three named graphs of nine HDT files each, made by rule."""

import json
import os

from graphloom.sources import codec
from graphloom.terms import literal

CORE, BIAN, KF, SD = (f"http://example.org/{x}/" for x in ("core", "bian", "kafka", "sd"))
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SERVICES = ["orders", "billing", "payments", "ledger", "notify", "audit"]


def svc(k):
    return f"{CORE}svc_{SERVICES[k % 6]}"


def bian(g, s):
    for i in range(4 + g + s):
        d, r = f"{BIAN}sd_{g}_{s}_{i}", f"{BIAN}cr_{g}_{s}_{i}"
        yield d, TYPE, BIAN + "ServiceDomain"
        yield d, BIAN + "name", literal(f"Service Domain {g}.{s}.{i}")
        yield d, BIAN + "businessArea", literal(["Retail Banking", "Corporate Banking", "Risk Management"][(i + g) % 3])
        yield d, BIAN + "controlRecord", r
        yield d, BIAN + "supportsService", svc(i + g + s)
        yield r, TYPE, BIAN + "ControlRecord"
        yield r, BIAN + "status", literal(["active", "review", "retired"][i % 3])
    if (g, s) == (1, 1):
        yield BIAN + "sd_1_1_0", BIAN + "deprecatedBy", BIAN + "sd_1_1_1"


def kafka(g, s):
    b = f"{KF}broker_{g}_{s}"
    yield b, TYPE, KF + "Broker"
    yield b, KF + "rack", literal(f"rack-{g}{s}")
    for i in range(3 + g + s):
        t = f"{KF}topic_{g}_{s}_{i}"
        yield t, TYPE, KF + "Topic"
        yield t, KF + "name", literal(f"{SERVICES[(i + g) % 6]}.events.v{g}{s}{i}")
        yield t, KF + "partitions", literal(["3", "6", "9", "12"][i % 4])
        yield t, KF + "replicationFactor", literal("23"[i % 2])
        yield t, KF + "hostedOn", b
        yield t, KF + "producedBy", svc(i + g)
        yield t, KF + "consumedBy", svc(i + s + 2)
    if (g, s) == (2, 3):
        yield KF + "topic_2_3_0", KF + "compaction", literal("delete")


def sd(g, s):
    for i in range(2 + g + s):
        d = f"{SD}dep_{g}_{s}_{i}"
        yield d, TYPE, SD + "Deployment"
        yield d, SD + "of", svc(i + g * s)
        yield d, SD + "version", literal(f"{g}.{s}.{i}")
        yield d, SD + "env", literal(["prod", "staging"][i % 2])
    if (g, s) == (1, 1):
        for k, name in enumerate(SERVICES):
            yield svc(k), TYPE, SD + "Service"
            yield svc(k), SD + "label", literal(f"{name.capitalize()} Service")
            yield svc(k), SD + "owner", f"{CORE}team_{['platform', 'risk', 'data'][k % 3]}"
            yield svc(k), SD + "tier", literal(str(1 + k % 3))
            yield svc(k), SD + "dependsOn", svc(k + 1)
        for name in ("platform", "risk", "data"):
            yield f"{CORE}team_{name}", TYPE, SD + "Team"
            yield f"{CORE}team_{name}", SD + "label", literal(f"{name.capitalize()} Team")
    if (g, s) == (3, 2):
        yield SD + "dep_3_2_0", SD + "rollbackOf", SD + "dep_3_1_0"


def write(folder):
    mapping = {}
    for name, make in (("bian", bian), ("kafka", kafka), ("sd", sd)):
        for g in (1, 2, 3):
            for s in (1, 2, 3):
                path = f"hdt/{name}/{name}{g}/{name}{g}_sample{s}.hdt"
                os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
                with open(f"{folder}/{path}", "wb") as f:
                    f.write(codec.encode(make(g, s)))
                mapping.setdefault(f"urn:hdt:{name}", []).append(path)
    with open(f"{folder}/map.json", "w") as f:
        json.dump(mapping, f)
    return mapping
