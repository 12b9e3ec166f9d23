"""Files that several drivers write: a run log, leases and the published estate."""
