"""tamisol.plans"""
