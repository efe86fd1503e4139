"""tablescope: how Spark tables are shaped, used, indexed and guarded."""
