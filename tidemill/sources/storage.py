"""Storage addresses and the Hadoop file systems that serve them."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

#: Scheme -> the scheme Spark reads it by.
SCHEMES = {"file": "file", "s3": "s3a", "s3a": "s3a", "azure": "abfss", "abfs": "abfss", "abfss": "abfss", "adls": "abfss", "wasbs": "wasbs", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "sftp": "sftp"}
#: Fixed value: what Hadoop needs to know for sftp addresses, as Spark settings.
SFTP_SETTINGS = {"spark.hadoop.fs.sftp.impl": "org.apache.hadoop.fs.sftp.SFTPFileSystem"}


@dataclass(frozen=True)
class StorageUri:
    scheme: str
    host: str
    path: str
    options: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> StorageUri:
        """An address such as s3://bucket/key?region=x, or a plain path."""
        if "://" not in text:
            return StorageUri("file", "", text)
        u = urlsplit(text)
        if not u.scheme:
            raise ValueError(f"no scheme in {text}")
        return StorageUri(u.scheme.lower(), u.netloc, unquote(u.path), dict(parse_qsl(u.query)))

    def spark_path(self) -> str:
        if self.scheme not in SCHEMES:
            raise ValueError(f"Spark has no file system for {self.scheme}")
        if self.scheme == "file":
            return f"file://{self.path}" if self.path.startswith("/") else self.path
        return f"{SCHEMES[self.scheme]}://{self.host}{self.path}"
