"""tamisol.sources"""
