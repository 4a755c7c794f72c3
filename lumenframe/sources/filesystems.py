"""Named file systems: a prefix stands for a root in local or remote storage."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from lumenframe.sources import SourceError

#: Arguments that each kind of file system takes.
ARGUMENTS = {
    "local": ("root",),
    "hdfs": ("host", "port", "user", "kerb_ticket", "root"),
    "s3": ("bucket_name", "access_key_id", "secret_key", "session_token", "encryption_type", "kms_key_amazon_resource_name", "endpoint_override", "region", "root"),
    "gs": ("project_id", "bucket_name", "use_default_adc_json_file", "adc_json_file", "root"),
}


@dataclass
class FileSystem:
    prefix: str
    kind: str
    base: str
    conf: dict[str, str] = field(default_factory=dict)


def describe(kind: str, prefix: str, args: dict[str, Any]) -> FileSystem:
    """Base URI and Hadoop settings of a file system; nothing is connected to."""
    if kind not in ARGUMENTS:
        raise SourceError(f"unknown kind of file system {kind!r}")
    if not prefix or "/" in prefix:
        raise SourceError(f"invalid prefix {prefix!r}")
    for name in args:
        if name not in ARGUMENTS[kind]:
            raise SourceError(f"unknown argument {name!r} for {kind}; there are {', '.join(ARGUMENTS[kind])}")
    root, conf = str(args.get("root") or "/").strip("/"), {}
    if kind == "local":
        return FileSystem(prefix, kind, f"file:///{root}".rstrip("/"))
    if kind == "hdfs":
        if args.get("kerb_ticket"):
            conf |= {"hadoop.security.authentication": "kerberos", "hadoop.security.kerberos.ticket.cache.path": str(args["kerb_ticket"])}
        host = f"{args.get('host') or '127.0.0.1'}:{args.get('port') or 8020}"
        return FileSystem(prefix, kind, f"hdfs://{host}/{root}".rstrip("/"), conf)
    bucket = args.get("bucket_name")
    if not bucket:
        raise SourceError("bucket_name is needed")
    if kind == "gs":
        conf["fs.gs.impl"] = "com.google.cloud.hadoop.fs.gcs.GoogleHadoopFileSystem"
        if args.get("project_id"):
            conf["fs.gs.project.id"] = str(args["project_id"])
        if args.get("adc_json_file") and not args.get("use_default_adc_json_file"):
            conf |= {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": str(args["adc_json_file"])}
        return FileSystem(prefix, kind, f"gs://{bucket}/{root}".rstrip("/"), conf)
    own = f"fs.s3a.bucket.{bucket}."
    if args.get("access_key_id"):
        conf |= {f"{own}access.key": str(args["access_key_id"]), f"{own}secret.key": str(args.get("secret_key") or "")}
        provider = "TemporaryAWSCredentialsProvider" if args.get("session_token") else "SimpleAWSCredentialsProvider"
        conf[f"{own}aws.credentials.provider"] = f"org.apache.hadoop.fs.s3a.{provider}"
    for name, key in (("session_token", "session.token"), ("endpoint_override", "endpoint"), ("region", "endpoint.region"), ("kms_key_amazon_resource_name", "encryption.key")):
        if args.get(name):
            conf[own + key] = str(args[name])
    how = str(args.get("encryption_type") or "none").upper().replace("_", "-")
    if how in ("AES-256", "AES256", "SSE-S3"):
        conf[f"{own}encryption.algorithm"] = "AES256"
    elif how in ("AWS-KMS", "SSE-KMS"):
        conf[f"{own}encryption.algorithm"] = "SSE-KMS"
    return FileSystem(prefix, kind, f"s3a://{bucket}/{root}".rstrip("/"), conf)


class FileSystems:
    """The registered prefixes of a session."""

    def __init__(self, spark: SparkSession):
        self._spark, self._known = spark, {}

    def register(self, kind: str, prefix: str, **args: Any) -> bool:
        fs = describe(kind, prefix, args)
        hadoop = self._spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in fs.conf.items():
            hadoop.set(k, v)
        self._known[prefix] = fs
        return True

    def resolve(self, path: str) -> str:
        """``scheme://prefix/rest`` as the URI below the prefix's root; other paths stay as they are."""
        if "://" not in path:
            return path
        authority, _, rest = path.split("://", 1)[1].partition("/")
        fs = self._known.get(authority)
        return f"{fs.base}/{rest}".rstrip("/") if fs else path

    def listing(self) -> list[tuple[str, str, str]]:
        """Prefix, kind and base of each; keys and tokens are never shown."""
        return [(f.prefix, f.kind, f.base) for f in self._known.values()]
