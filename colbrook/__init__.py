"""A columnar update and view engine on PySpark."""

#: Grows when a name of the public interface changes its meaning.
API_VERSION = 1
