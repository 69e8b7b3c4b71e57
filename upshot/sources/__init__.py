from .files import read_csv, read_source, save_table, write_result
from .tables import SCHEMAS, Tables, read_table, register_views

__all__ = ["SCHEMAS", "Tables", "read_table", "register_views", "read_csv",
           "read_source", "write_result", "save_table"]
