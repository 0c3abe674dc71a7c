"""lorefield.plans"""
