"""factorseg.plans"""
